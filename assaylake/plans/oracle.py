"""DuckDB SQL equivalents of the registered queries (same column names)."""

from __future__ import annotations

from assaylake.functions.text import ANSWER_PAIR_REGEX
from assaylake.plans.catalog import TEXT_PATTERNS
from assaylake.schema import PROPERTIES

SQL: dict[str, str] = {}

# lineitem in the measurement role: zero discount / tax = not measured.
_M = """m AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
         l_quantity, l_extendedprice,
         nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.0) AS l_tax
  FROM lineitem)"""
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_VALS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_FRAC = {"l_quantity": 0.3, "l_extendedprice": 0.3, "l_discount": 0.2, "l_tax": 0.2}


def _log10p1(x: str) -> str:
    return (f"CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) + 1 = 0 THEN '-inf'::DOUBLE "
            f"WHEN ({x}) + 1 < 0 THEN 'nan'::DOUBLE ELSE log10(({x}) + 1) END")


_SD = "sd AS (SELECT " + ", ".join(
    f"stddev_samp({v}) AS sd_{v}" for v in _VALS) + " FROM m)"
_G = ("g AS (SELECT l_partkey, l_suppkey, count(*) AS n_rows, " + ", ".join(
    f"min({v}) AS mn_{v}, max({v}) AS mx_{v}, avg({v}) AS av_{v}" for v in _VALS)
    + " FROM m GROUP BY l_partkey, l_suppkey)")
_FLAG = {v: f"coalesce((mx_{v} - mn_{v}) > sd_{v} * {_FRAC[v]}, false)" for v in _VALS}

SQL["consensus"] = f"""
WITH {_M}, {_SD}, {_G},
first AS (
  SELECT * FROM (
    SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_returnflag,
           row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {_ORDER}) AS rn
    FROM m) WHERE rn = 1),
c AS (
  SELECT g.l_partkey, g.l_suppkey, f.l_orderkey, f.l_linenumber, f.l_returnflag, g.n_rows,
         {", ".join(f"CASE WHEN NOT {_FLAG[v]} THEN av_{v} END AS {v}" for v in _VALS)}
  FROM g CROSS JOIN sd JOIN first f USING (l_partkey, l_suppkey))
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_returnflag, n_rows,
       {", ".join(f"round({v}, 6) AS {v}" for v in _VALS)},
       {", ".join(f"round({_log10p1(v)}, 6) AS log_{v}" for v in _VALS)}
FROM c"""

SQL["disagreement_flags"] = f"""
WITH {_M}, {_SD}, {_G}
SELECT l_partkey, l_suppkey, {", ".join(f"{_FLAG[v]} AS {v}_noisy" for v in _VALS)}
FROM g CROSS JOIN sd"""

SQL["endpoint_std"] = f"""
WITH {_M}
SELECT {", ".join(f"round(stddev_samp({v}), 6) AS sd_{v}" for v in _VALS)} FROM m"""

SQL["first_per_key"] = f"""
WITH {_M}
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {_ORDER}) AS rn
      FROM m) WHERE rn = 1"""

SQL["log_transform"] = f"""
WITH {_M}
SELECT {_ORDER}, {", ".join(f"round({_log10p1(v)}, 6) AS log_{v}" for v in _VALS)} FROM m"""


# --- step 2 -----------------------------------------------------------------

def _log10(x: str) -> str:
    return (f"CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) = 0 THEN '-inf'::DOUBLE "
            f"WHEN ({x}) < 0 THEN 'nan'::DOUBLE ELSE log10({x}) END")


_FLOOR = {"l_quantity": 0.5, "l_extendedprice": 0.5, "l_discount": 0.001, "l_tax": None}


def _log_floor(v: str) -> str:
    f = _FLOOR[v]
    return _log10(v) if f is None else _log10(f"CASE WHEN {v} IS NOT NULL THEN greatest({v}, {f}) END")


def _digest(x: str, name: str) -> str:
    return f"md5({x}) AS {name}_md5, length({x})::BIGINT AS {name}_len"


def _fmt2(x: str) -> str:
    return (f"CASE WHEN ({x}) IS NULL THEN NULL WHEN isnan({x}) THEN 'nan' "
            f"WHEN ({x}) = 'inf'::DOUBLE THEN 'inf' WHEN ({x}) = '-inf'::DOUBLE THEN '-inf' "
            f"ELSE printf('%.2f', {x}) END")


def _unit(key: str, part: int) -> str:
    return f"((('0x' || substr(md5({key}), {1 + 8 * part}, 8))::BIGINT + 0.5) / 4294967296.0)"


def _gauss(key: str, sd: float) -> str:
    return f"(sqrt(-2.0 * ln({_unit(key, 0)})) * cos(2.0 * pi() * {_unit(key, 1)}) * {sd})"


SQL["scan_roundtrip"] = f"WITH {_M} SELECT * FROM m"

SQL["log_floor"] = f"""
WITH {_M}
SELECT {_ORDER}, {", ".join(f"round({_log_floor(v)}, 6) AS lf_{v}" for v in _VALS)} FROM m"""

SQL["log_edges"] = f"""
SELECT c_custkey, round({_log10('c_acctbal')}, 6) AS log_acctbal,
       round({_log10p1('c_acctbal')}, 6) AS log1p_acctbal
FROM customer"""

SQL["back_transform"] = f"""
WITH {_M}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {", ".join(f"round(pow(10.0, {_log10p1(v)}) - 1.0, 6) AS {v}" for v in _VALS)}
FROM m"""

SQL["format_two_decimals"] = f"""
SELECT {_ORDER}, {_fmt2('l_extendedprice * (1 - l_discount)')} AS net_txt,
       {_fmt2('l_quantity / 7')} AS qty7_txt,
       trunc(l_extendedprice / 7)::BIGINT AS price7_int
FROM lineitem"""

SQL["jitter"] = f"""
WITH {_M}
SELECT {_ORDER},
       round({_gauss("concat_ws(':', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)", 0.02)}, 6)
         AS jitter
FROM m"""

_SUFFIX = "CASE WHEN text IS NULL THEN NULL WHEN instr(text, '|') > 0 THEN substr(text, instr(text, '|')) ELSE '' END"
SQL["extension_suffix"] = f"SELECT doc_id, {_digest(_SUFFIX, 'suffix')} FROM documents"

_NORM = r"trim(regexp_replace(lower(text), '[\t\n\x0B\f\r ]+', ' ', 'g'))"
_KEYS = f"""k AS (
  SELECT doc_id, CASE WHEN length(n) < 10 OR regexp_matches(n, '[0-9]{{6,}}') THEN NULL ELSE n END AS key
  FROM (SELECT doc_id, {_NORM} AS n FROM documents))"""
SQL["normalise_keys"] = f"WITH {_KEYS} SELECT doc_id, {_digest('key', 'key')} FROM k"
_LARGEST_OF = ("list_reduce(list_prepend('', string_split({x}, '.')), "
               "lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END)")
SQL["second_keys"] = f"""WITH {_KEYS},
s AS (SELECT doc_id, key, {_NORM.replace('text', _LARGEST_OF.format(x='key'))} AS n FROM k),
t AS (SELECT doc_id, key, CASE WHEN key IS NULL OR length(n) < 10 OR regexp_matches(n, '[0-9]{{6,}}')
                               THEN NULL ELSE n END AS second FROM s)
SELECT doc_id, {_digest('key', 'key')}, {_digest('second', 'second')} FROM t"""
SQL["reject_count"] = f"WITH {_KEYS} SELECT count(*) FILTER (WHERE key IS NULL)::BIGINT AS n_rejected FROM k"

_LARGEST = ("list_reduce(list_prepend('', string_split(text, '.')), "
            "lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END)")
SQL["largest_component"] = f"SELECT doc_id, {_digest(_LARGEST, 'component')} FROM documents"

SQL["duplicate_members"] = f"""
WITH {_M}
SELECT * FROM (SELECT {_ORDER}, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS group_size FROM m)
WHERE group_size > 1"""

SQL["duplicate_extras"] = f"""
WITH {_M}
SELECT {_ORDER}, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {_ORDER}) > 1 AS is_extra
FROM m"""

SQL["keyed_members"] = f"""
WITH {_M}
SELECT {_ORDER}, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {_ORDER}) > 1 AS is_extra,
       count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS group_size FROM m"""

SQL["duplicate_key_count"] = f"""
WITH {_M}
SELECT count(*)::BIGINT AS n_duplicated_keys FROM (
  SELECT l_partkey, l_suppkey FROM m WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL
  GROUP BY ALL HAVING count(*) > 1)"""

SQL["group_range"] = f"""
WITH {_M}, x AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {_ORDER}) AS rn
                 FROM m) WHERE rn > 1)
SELECT l_partkey, l_suppkey, {", ".join(f"round(max({v}) - min({v}), 6) AS range_{v}" for v in _VALS)}
FROM x WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY l_partkey, l_suppkey"""

SQL["group_number"] = f"""
WITH {_M}
SELECT {_ORDER}, (dense_rank() OVER (ORDER BY l_partkey, l_suppkey) - 1)::BIGINT AS group_no FROM m"""

_FOLDS = """f AS (
  SELECT l_partkey, l_suppkey,
         ntile(5) OVER (ORDER BY md5(concat_ws(':', '42', l_partkey, l_suppkey)), l_partkey, l_suppkey) - 1
           AS val_fold
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)),
kf AS (
  SELECT l_partkey, l_suppkey, r.fold::INTEGER AS fold,
         CASE WHEN r.fold = val_fold THEN 'val' ELSE 'train' END AS split
  FROM f CROSS JOIN range(5) r(fold))"""
SQL["kfold"] = f"WITH {_FOLDS} SELECT * FROM kf"
SQL["kfold_sizes"] = f"""
WITH {_FOLDS}
SELECT fold, count(*) FILTER (WHERE split = 'train')::BIGINT AS n_train,
       count(*) FILTER (WHERE split = 'val')::BIGINT AS n_val
FROM kf GROUP BY fold"""

_TRAIN = "SELECT d.doc_id, d.text, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)"
_TEST = "SELECT d.doc_id, d.text FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)"
_EXT = "SELECT item_id, text FROM benchmark"
SQL["tagged_union"] = f"""
SELECT split, doc_id, item_id, quality, toxic, {_digest('text', 'text')} FROM (
  SELECT 'train' AS split, doc_id, NULL::BIGINT AS item_id, quality, toxic, text FROM ({_TRAIN})
  UNION ALL SELECT 'test', doc_id, NULL, NULL, NULL, text FROM ({_TEST})
  UNION ALL SELECT 'external', NULL, item_id, NULL, NULL, text FROM ({_EXT}))"""

_REFS = f"""refs AS (
  SELECT (row_number() OVER (ORDER BY origin, coalesce(doc_id, item_id)) - 1)::BIGINT AS ref_id, *
  FROM (
    SELECT 0 AS origin, 'train' AS split, doc_id, NULL::BIGINT AS item_id, quality, toxic, text
    FROM ({_TRAIN})
    UNION ALL SELECT 1, 'external', NULL, item_id, NULL, NULL, text FROM ({_EXT})))"""
SQL["reference_union"] = f"""
WITH {_REFS}
SELECT ref_id, split, doc_id, item_id, quality, toxic, {_digest('text', 'text')} FROM refs"""

SQL["flatten_records"] = """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events"""


SQL["flatten_ids"] = "SELECT event_id AS record_id FROM events"
SQL["accepted_keys"] = f"WITH {_KEYS} SELECT doc_id, {_digest('key', 'key')} FROM k WHERE key IS NOT NULL"
SQL["positional_profile"] = " UNION ALL ".join(
    f"SELECT '{v}' AS \"column\", round(avg((CASE WHEN {v} > 10 THEN {v} END IS NULL)::DOUBLE) * 100, 6) AS null_pct "
    "FROM lineitem" for v in _VALS)
SQL["cached_table"] = f"WITH {_M} SELECT * FROM m"
SQL["named_output"] = (f"SELECT item_id, {_digest('text', 'text')}, 'records_top5target_3ext_train' AS run "
                       "FROM benchmark")

# --- step 3 -----------------------------------------------------------------

_DL = """d AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
      FROM documents d LEFT JOIN labels l USING (doc_id))"""
_DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
SQL["null_profile"] = f"WITH {_DL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(({c} IS NULL)::DOUBLE) * 100, 6) AS null_pct FROM d"
    for c in _DOC_COLS)
SQL["all_null_pct"] = f"""WITH {_DL}
SELECT round(avg((coalesce(quality, toxic) IS NULL)::DOUBLE) * 100, 6) AS all_null_pct FROM d"""


def _long(src: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS value FROM {src} WHERE {c} IS NOT NULL"
        for c in cols)


SQL["describe_columns"] = f"""
WITH long AS ({_long('part', ['p_size', 'p_retailprice'])})
SELECT "column", count(*)::BIGINT AS count, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
       round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
       round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max
FROM long GROUP BY "column" """


def _hist(nbins_sql: str, ctes: str = f"{_M}, long AS ({_long('m', _VALS)})", lo: float | None = None,
          hi: float | None = None) -> str:
    where, mn, mx = ("", "min(value)", "max(value)") if lo is None else (
        f"WHERE value BETWEEN {lo} AND {hi}", f"{lo}::DOUBLE", f"{hi}::DOUBLE")
    return f"""
WITH {ctes.replace('long AS', 'long0 AS')}, long AS (SELECT * FROM long0 {where}),
st AS (SELECT "column", count(*) AS n, {mn} AS mn, {mx} AS mx, max(value) - min(value) AS ptp,
              quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
       FROM long GROUP BY "column"),
w AS (SELECT *, CASE WHEN mx = mn THEN mn - 0.5 ELSE mn END AS lo,
                CASE WHEN mx = mn THEN mx + 0.5 ELSE mx END AS hi,
                least(greatest(2.0 * iqr * pow(n::DOUBLE, -1.0 / 3.0), ptp / sqrt(n) / 2.0),
                      ptp / (log2(n) + 1.0)) AS width
      FROM st),
e AS (SELECT "column", lo, hi, ({nbins_sql})::BIGINT AS nbins,
      FROM w),
c AS (SELECT l."column", least(floor((value - lo) / (hi - lo) * nbins), nbins - 1)::BIGINT AS bin,
             count(*) AS cnt
      FROM long l JOIN e USING ("column") GROUP BY ALL),
b AS (SELECT "column", lo, hi, nbins, unnest(range(nbins)) AS bin FROM e)
SELECT b."column", b.bin, round(lo + bin * ((hi - lo) / nbins), 6) AS bin_lo,
       round(lo + (bin + 1) * ((hi - lo) / nbins), 6) AS bin_hi, coalesce(cnt, 0)::BIGINT AS count
FROM b LEFT JOIN c USING ("column", bin)"""


SQL["histogram_auto"] = _hist("CASE WHEN width > 0 THEN ceil((hi - lo) / width) ELSE 1 END")
SQL["histogram_fixed"] = _hist("30")
SQL["histogram_range"] = _hist("CASE WHEN width > 0 THEN ceil((hi - lo) / width) ELSE 1 END", lo=0.02, hi=40.0)
SQL["group_range_histogram"] = _hist("30", f"""{_M}, x AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {_ORDER}) AS rn
                 FROM m) WHERE rn > 1),
gr AS (SELECT {", ".join(f"max({v}) - min({v}) AS range_{v}" for v in _VALS)}
       FROM x WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY l_partkey, l_suppkey),
long AS ({_long('gr', [f"range_{v}" for v in _VALS])})""")

_corr_parts = []
for _i, _a in enumerate(_VALS):
    for _b in _VALS[_i:]:
        _sub = (f"SELECT covar_samp({_a}, {_b}) AS cv, "
                f"stddev_samp(CASE WHEN {_b} IS NOT NULL THEN {_a} END) AS sx, "
                f"stddev_samp(CASE WHEN {_a} IS NOT NULL THEN {_b} END) AS sy FROM m")
        _r = "round(CASE WHEN sx * sy > 0 THEN cv / (sx * sy) END, 6)"
        _corr_parts.append(f"SELECT '{_a}' AS col_x, '{_b}' AS col_y, {_r} AS r FROM ({_sub})")
        if _a != _b:
            _corr_parts.append(f"SELECT '{_b}' AS col_x, '{_a}' AS col_y, {_r} AS r FROM ({_sub})")
SQL["corr_matrix"] = f"WITH {_M} " + " UNION ALL ".join(_corr_parts)

SQL["linear_fit_matrix"] = f"WITH {_M} " + " UNION ALL ".join(
    f"SELECT '{x}' AS col_x, '{y}' AS col_y, round(regr_slope({y}, {x}), 6) AS slope, "
    f"round(regr_intercept({y}, {x}), 6) AS intercept FROM m"
    for x in _VALS for y in _VALS if x != y)

SQL["incremental_consensus"] = SQL["consensus"]
SQL["incremental_flags"] = SQL["disagreement_flags"]
SQL["pair_statistics"] = f"WITH {_M} " + " UNION ALL ".join(
    f"SELECT '{x}' AS col_x, '{y}' AS col_y, count(*)::BIGINT AS n, "
    f"round(CASE WHEN stddev_samp(y) * stddev_samp(x) > 0 THEN covar_samp(y, x) / (stddev_samp(y) * stddev_samp(x)) END, 6) AS r, "
    "round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept "
    f"FROM (SELECT {x} AS x, {y} AS y FROM m WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    for x in _VALS for y in _VALS)

SQL["smallest_values"] = f"""
WITH {_M}, long AS ({_long('m', _VALS)}),
r AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) AS rank FROM long)
SELECT rank::INTEGER AS rank, {", ".join(f"max(value) FILTER (WHERE \"column\" = '{v}') AS {v}" for v in _VALS)}
FROM r WHERE rank <= 10 GROUP BY rank"""


def _positive_zero(sql: str) -> str:
    """Rewrite every ``round(expr, 6)`` to ``round(expr * 1e6) / 1e6 + 0.0``.

    The Spark side rounds with the same steps; Spark's rounding never yields
    -0.0 while DuckDB's does, and adding +0.0 turns -0.0 into 0.0.
    """
    out, i, token = [], 0, "round("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k = 0, j + len(token) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _positive_zero(sql[j + len(token):k])
        expr, _, places = inner.rpartition(",")
        if places.strip() != "6":
            raise ValueError(f"round to 6 places expected: {inner}")
        out.append(f"(round(({expr}) * 1000000.0) / 1000000.0 + 0.0)")
        i = k + 1


_FINAL: dict[str, str] = {}


def finalize() -> dict[str, str]:
    """The oracle statements, signed zeros normalised (idempotent)."""
    for key, sql in SQL.items():
        if key not in _FINAL:
            _FINAL[key] = _positive_zero(sql)
    return dict(_FINAL)


# --- step 4 -----------------------------------------------------------------

_ANS_RE = ANSWER_PAIR_REGEX.removeprefix("(?U)")
_K = "json_extract_string(props, '$.k')"
_CAND = f"""cand AS (
  SELECT user_id AS query_id, event_id AS candidate_no,
    CASE WHEN event_type = 'error' AND value > 300 THEN 'no answer'
         WHEN event_type = 'purchase' THEN 'LogD=' || {_fmt2('value / 100')} || ', LogD=' ||
              {_fmt2(f'CAST({_K} AS INTEGER) / 10')} || ', k=' || {_K}
         WHEN event_type = 'view' THEN 'LogMDR1-MDCKII=' || {_fmt2('value / 100')} || '; Other-Name=' ||
              {_fmt2(f'CAST({_K} AS INTEGER) / 10')}
         ELSE (CASE event_type WHEN 'click' THEN 'LogHLM' WHEN 'error' THEN 'LogMLM'
               WHEN 'signup' THEN 'LogKSOL' END) || '=' || {_fmt2('value / 100')} || ', k=' || {_K}
    END AS text
  FROM events)"""
_PARSED = f"""parsed AS (
  SELECT query_id, candidate_no, pair_no::INTEGER AS pair_no, names[pair_no] AS name,
         vals[pair_no]::DOUBLE AS value
  FROM (SELECT query_id, candidate_no, names, vals, unnest(generate_series(1, len(names))) AS pair_no
        FROM (SELECT query_id, candidate_no,
                     regexp_extract_all(trim(text), '{_ANS_RE}', 1) AS names,
                     regexp_extract_all(trim(text), '{_ANS_RE}', 2) AS vals FROM cand)))"""
_PROPS = PROPERTIES
_AVG = f"""avgd AS (
  SELECT c.query_id,
         {", ".join(f'CASE WHEN NOT bool_or(p.pair_no IS NULL) THEN avg(p.value) FILTER (WHERE p.name = \'{p}\') END AS "{p}"' for p in _PROPS)}
  FROM cand c LEFT JOIN parsed p USING (query_id, candidate_no)
  GROUP BY c.query_id)"""

SQL["parse_answers"] = f"""WITH {_CAND}, {_PARSED}
SELECT query_id, candidate_no, pair_no, name, value FROM parsed"""
SQL["average_answers"] = f"""WITH {_CAND}, {_PARSED}, {_AVG}
SELECT query_id, {", ".join(f'round("{p}", 6) AS "{p}"' for p in _PROPS)} FROM avgd"""
_LOGGED = ["HLM", "MLM", "KSOL", "MDR1-MDCKII"]
SQL["attach_predictions"] = f"""WITH {_CAND}, {_PARSED}, {_AVG},
rows AS (SELECT DISTINCT user_id AS query_id FROM events)
SELECT r.query_id, {", ".join(f'round(a."{p}", 6) AS "pred_{p}"' for p in _PROPS)},
       {", ".join(f'round(pow(10.0, a."Log{e}") - 1.0, 6) AS "pred_{e}"' for e in _LOGGED)}
FROM rows r LEFT JOIN avgd a USING (query_id)"""

_EVAL = f"""ev AS (
  SELECT endpoint, y, p FROM (
    SELECT l_returnflag AS endpoint,
           CASE WHEN l_returnflag = 'N' THEN ref ELSE {_log10p1('ref')} END AS y,
           CASE WHEN l_returnflag = 'N' THEN pred ELSE {_log10p1('pred')} END AS p
    FROM (SELECT l_returnflag, CASE WHEN l_discount <> 0 THEN l_extendedprice END AS ref,
                 l_quantity * 1500 AS pred FROM lineitem))
  WHERE y IS NOT NULL),
per AS (
  SELECT endpoint, count(*)::BIGINT AS n, avg(abs(y - p)) AS mean_absolute_error,
         CASE WHEN count(*) < 2 THEN NULL
              WHEN var_pop(y) * count(*) = 0 THEN CASE WHEN sum((y - p) ^ 2) = 0 THEN 1.0 ELSE 0.0 END
              ELSE 1.0 - sum((y - p) ^ 2) / (var_pop(y) * count(*)) END AS r2
  FROM ev GROUP BY endpoint)"""
SQL["evaluate"] = f"""WITH {_EVAL}
SELECT endpoint, n, round(mean_absolute_error, 6) AS mean_absolute_error, round(r2, 6) AS r2 FROM per"""
SQL["evaluate_nan_truths"] = SQL["evaluate"]
SQL["evaluate_macro"] = f"""WITH {_EVAL}
SELECT 'aggregated' AS endpoint, sum(n)::BIGINT AS n, round(avg(mean_absolute_error), 6) AS mean_absolute_error,
       round(avg(r2), 6) AS r2 FROM per"""


_SCORED = " UNION ALL ".join(
    f"SELECT '{v}' AS endpoint, {_log10p1(v)} AS y, "
    f"{_log10p1('pow(10.0, ' + _log10p1(f'coalesce({v}, 0.0) * 1.1 + 0.5') + ') - 1.0')} AS p FROM m WHERE {v} IS NOT NULL"
    for v in _VALS)
SQL["score_end_to_end"] = f"""WITH {_M}, ev AS ({_SCORED}),
per AS (
  SELECT endpoint, count(*)::BIGINT AS n, avg(abs(y - p)) AS mae,
         1.0 - sum((y - p) ^ 2) / (var_pop(y) * count(*)) AS r2 FROM ev GROUP BY endpoint)
SELECT endpoint, n, round(mae, 6) AS mean_absolute_error, round(r2, 6) AS r2 FROM per
UNION ALL SELECT 'aggregated', sum(n)::BIGINT, round(avg(mae), 6), round(avg(r2), 6) FROM per"""


# --- step 5 -----------------------------------------------------------------

_NW = 16


def _signed(u: str) -> str:
    return (f"CASE WHEN {u} >= 9223372036854775808 THEN "
            f"({u} - 9223372036854775808::UBIGINT)::BIGINT + (-9223372036854775807 - 1) "
            f"ELSE {u}::BIGINT END")


def _hashed_fp(src: str, id_col: str) -> str:
    """Per-row words u0..u15 (UBIGINT) and pc, NULL when the text has no token."""
    words = ", ".join(
        f"coalesce(bit_or(CASE WHEN b // 64 = {j} THEN (1::UBIGINT << (b % 64)::INTEGER) END), 0::UBIGINT) AS u{j}"
        for j in range(_NW))
    pc = " + ".join(f"bit_count(w.u{j})::INTEGER" for j in range(_NW))
    return f"""(
  WITH tok AS (
    SELECT {id_col}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t
    FROM {src}),
  grams AS (
    SELECT {id_col}, unnest(list_concat(
      t,
      CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END,
      CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1),
           lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) ELSE [] END)) AS g
    FROM tok),
  bits AS (SELECT {id_col}, ('0x' || substr(md5(g), 1, 8))::BIGINT % 1024 AS b FROM grams),
  w AS (SELECT {id_col}, {words} FROM bits GROUP BY {id_col})
  SELECT s.{id_col}, {", ".join(f"w.u{j}" for j in range(_NW))}, ({pc})::INTEGER AS pc
  FROM {src} s LEFT JOIN w USING ({id_col}))"""


SQL["hashed_fingerprint"] = f"""
SELECT doc_id, {", ".join(f"{_signed(f'u{j}')} AS w{j:02d}" for j in range(_NW))}, pc AS n_bits_set
FROM {_hashed_fp('documents', 'doc_id')}"""

def _pattern_terms() -> str:
    return " | ".join(
        f"(CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') "
        f"THEN (1::UBIGINT << {i}) ELSE 0::UBIGINT END)"
        for i, p in enumerate(TEXT_PATTERNS))


def _pattern_fp(src: str, id_col: str) -> str:
    terms = _pattern_terms()
    return f"(SELECT {id_col}, {terms} AS u0, bit_count({terms})::INTEGER AS pc FROM {src})"


SQL["pattern_fingerprint"] = f"""
SELECT doc_id, {_signed('u0')} AS w00, pc AS n_bits_set FROM {_pattern_fp('documents', 'doc_id')}"""

_TOKS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_FEATS = [
    ("chars", "length(text)", "int"),
    ("words", f"len({_TOKS})", "int"),
    ("lines", "len(string_split(text, chr(10)))", "int"),
    ("digits", "length(regexp_replace(text, '[^0-9]', '', 'g'))", "int"),
    ("upper", "length(regexp_replace(text, '[^A-Z]', '', 'g'))", "int"),
    ("avgword", f"length(text) / nullif(len({_TOKS}), 0)", "2f"),
]
SQL["profile_text"] = "SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE concat_ws(', ', " + ", ".join(
    f"'{n}=' || " + (f"trunc({e})::BIGINT::VARCHAR" if k == "int" else _fmt2(e))
    for n, e, k in _FEATS) + ") END AS profile FROM documents"

_FPW = f"fpw AS {_hashed_fp('documents', 'doc_id')}"
_TT = """train AS (SELECT * FROM fpw WHERE pc IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels)),
test AS (SELECT * FROM fpw WHERE pc IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels))"""
_INTER = " + ".join(f"bit_count(a.u{j} & b.u{j})::INTEGER" for j in range(_NW))


def _pairs(a: str, b: str, cond: str = "true") -> str:
    return f"""pairs AS (
  SELECT i, j, inter, pa + pb - inter AS uni FROM (
    SELECT a.doc_id AS i, b.doc_id AS j, a.pc AS pa, b.pc AS pb, ({_INTER}) AS inter
    FROM {a} a, {b} b WHERE {cond}))"""


def _sim_hist(bins: int = 30) -> str:
    return f"""s AS (SELECT inter / uni AS sim FROM pairs WHERE uni > 0),
e AS (SELECT CASE WHEN max(sim) = min(sim) THEN min(sim) - 0.5 ELSE min(sim) END AS lo,
             CASE WHEN max(sim) = min(sim) THEN max(sim) + 0.5 ELSE max(sim) END AS hi FROM s),
c AS (SELECT least(floor((sim - lo) / (hi - lo) * {bins}), {bins - 1})::BIGINT AS bin, count(*) AS cnt
      FROM s, e GROUP BY ALL)
SELECT r.bin, round(lo + r.bin * ((hi - lo) / {bins}), 6) AS bin_lo,
       round(lo + (r.bin + 1) * ((hi - lo) / {bins}), 6) AS bin_hi, coalesce(cnt, 0)::BIGINT AS count
FROM (SELECT range AS bin FROM range({bins})) r CROSS JOIN e LEFT JOIN c USING (bin)"""


SQL["tanimoto_pairs"] = f"WITH {_FPW}, {_TT}, {_pairs('train', 'test')}, {_sim_hist()}"
SQL["nearest_left"] = f"""WITH {_FPW}, {_TT}, {_pairs('train', 'test')}
SELECT i AS doc_id, round(max(inter / uni), 6) AS best_sim FROM pairs WHERE uni > 0 GROUP BY i"""
SQL["nearest_right"] = f"""WITH {_FPW}, {_TT}, {_pairs('train', 'test')}
SELECT j AS doc_id, round(max(inter / uni), 6) AS best_sim FROM pairs WHERE uni > 0 GROUP BY j"""
SQL["nearest_other"] = f"""WITH {_FPW}, {_TT}, {_pairs('train', 'train', 'a.doc_id <> b.doc_id')}
SELECT i AS doc_id, round(max(inter / uni), 6) AS best_sim FROM pairs WHERE uni > 0 GROUP BY i"""
SQL["nearest_histogram"] = f"""WITH {_FPW}, {_TT}, {_pairs('train', 'train', 'a.doc_id <> b.doc_id')},
best AS (SELECT i, max(inter / uni) AS sim FROM pairs WHERE uni > 0 GROUP BY i),
e AS (SELECT CASE WHEN max(sim) = min(sim) THEN min(sim) - 0.5 ELSE min(sim) END AS lo,
             CASE WHEN max(sim) = min(sim) THEN max(sim) + 0.5 ELSE max(sim) END AS hi FROM best),
c AS (SELECT least(floor((sim - lo) / (hi - lo) * 30), 29)::BIGINT AS bin, count(*) AS cnt FROM best, e GROUP BY ALL)
SELECT 'best_sim' AS "column", r.bin, round(lo + r.bin * ((hi - lo) / 30), 6) AS bin_lo,
       round(lo + (r.bin + 1) * ((hi - lo) / 30), 6) AS bin_hi, coalesce(cnt, 0)::BIGINT AS count
FROM (SELECT range AS bin FROM range(30)) r CROSS JOIN e LEFT JOIN c USING (bin)"""
SQL["threshold_pairs"] = f"""WITH {_FPW}, {_TT}, {_pairs('train', 'train', 'a.doc_id < b.doc_id')}
SELECT i AS left_id, j AS right_id, round(inter / uni, 6) AS sim FROM pairs WHERE uni > 0 AND inter / uni >= 0.5"""
_LINKED = f"""{_FPW}, {_TT}, {_pairs('train', 'train', 'a.doc_id <> b.doc_id')},
cls AS (SELECT doc_id, pc, min(doc_id) OVER w AS class_id, count(*) OVER w AS n FROM train
        WINDOW w AS (PARTITION BY {", ".join(f"u{j}" for j in range(_NW))}))"""
SQL["threshold_links"] = f"""WITH {_LINKED},
links AS (SELECT i, count(*) AS n FROM pairs WHERE uni > 0 AND inter / uni >= 0.5 GROUP BY i)
SELECT c.doc_id, c.class_id, CASE WHEN c.pc > 0 THEN c.n - 1 ELSE 0 END::BIGINT AS n_copies,
       coalesce(l.n, 0)::BIGINT AS n_links FROM cls c LEFT JOIN links l ON l.i = c.doc_id"""
SQL["threshold_class_pairs"] = f"""WITH {_LINKED}
SELECT i AS left_class, j AS right_class, round(inter / uni, 6) AS sim FROM pairs
JOIN cls a ON a.doc_id = i AND a.class_id = i JOIN cls b ON b.doc_id = j AND b.class_id = j
WHERE i < j AND uni > 0 AND inter / uni >= 0.5"""
SQL["pair_histogram"] = f"WITH {_FPW}, {_TT}, {_pairs('train', 'train', 'a.doc_id < b.doc_id')}, {_sim_hist()}"

_IDENT = f"""ident AS (
  SELECT a.doc_id AS i, b.doc_id AS j FROM train a JOIN train b ON a.doc_id <> b.doc_id AND a.pc > 0
   AND {" AND ".join(f"a.u{j} = b.u{j}" for j in range(_NW))})"""
SQL["identical_pairs"] = f"""WITH {_FPW}, {_TT}, {_IDENT}
SELECT i AS doc_id, least(i, min(j))::BIGINT AS twin_group, count(*)::BIGINT AS n_partners FROM ident GROUP BY i"""
SQL["identical_pairs_head"] = f"""WITH {_FPW}, {_TT}, {_IDENT}
SELECT i, j FROM ident ORDER BY i, j LIMIT 10"""
SQL["identical_pair_rows"] = f"""WITH {_FPW}, {_TT}, {_IDENT}, p AS (SELECT i, j FROM ident ORDER BY i, j LIMIT 10)
SELECT i, j, a.lang AS i_lang, b.lang AS j_lang, a.n_chars AS i_n_chars, b.n_chars AS j_n_chars,
       {_digest('a.text', 'i_text')}, {_digest('b.text', 'j_text')}
FROM p JOIN documents a ON a.doc_id = i JOIN documents b ON b.doc_id = j"""
SQL["near_identical_count"] = f"""WITH {_FPW}, {_TT}, {_IDENT}
SELECT count(DISTINCT i)::BIGINT AS n_rows_identical, count(*)::BIGINT AS n_identical_pairs FROM ident"""

_EMB = """emb AS (
  SELECT vec_id AS doc_id,
         list_reduce(list_prepend(0::UBIGINT, list_transform(range(1, len(embedding) + 1),
           lambda i: CASE WHEN embedding[i] > 0 THEN (1::UBIGINT << (i - 1)::INTEGER) ELSE 0::UBIGINT END)),
           lambda a, b: a | b) AS u0
  FROM embeddings),
ew AS (SELECT doc_id, u0, bit_count(u0)::INTEGER AS pc FROM emb)"""
SQL["embedding_nearest"] = f"""WITH {_EMB},
pairs AS (SELECT a.doc_id AS i, bit_count(a.u0 & b.u0)::INTEGER AS inter,
                 a.pc + b.pc - bit_count(a.u0 & b.u0)::INTEGER AS uni
          FROM ew a, ew b WHERE a.doc_id <> b.doc_id)
SELECT i AS vec_id, round(max(inter / uni), 6) AS best_sim FROM pairs WHERE uni > 0 GROUP BY i"""

SQL["query_reference_sim"] = f"""WITH q AS {_pattern_fp('documents', 'doc_id')}, r AS {_pattern_fp('benchmark', 'item_id')},
pairs AS (SELECT q.doc_id, r.item_id, bit_count(q.u0 & r.u0)::INTEGER AS inter,
                 q.pc + r.pc - bit_count(q.u0 & r.u0)::INTEGER AS uni FROM q, r),
ranked AS (SELECT doc_id, item_id, inter / uni AS sim,
                  row_number() OVER (PARTITION BY doc_id ORDER BY inter / uni DESC, item_id) AS rank
           FROM pairs WHERE uni > 0)
SELECT doc_id, rank::INTEGER AS rank, item_id, round(sim, 6) AS sim FROM ranked WHERE rank <= 3"""


# --- step 6 -----------------------------------------------------------------

_PROFILE = "CASE WHEN text IS NULL THEN '' ELSE concat_ws(', ', " + ", ".join(
    f"'{n}=' || " + (f"trunc({e})::BIGINT::VARCHAR" if k == "int" else _fmt2(e))
    for n, e, k in _FEATS) + ") END"

_RQ = f"""
rsrc AS (
  SELECT ref_id, text, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic,
         CASE WHEN split = 'train' THEN {_log10p1('length(text)')} END AS log_chars,
         CASE WHEN split = 'external' THEN {_log10p1('length(text)')} END AS ext_log_len,
         CASE WHEN split = 'external' THEN {_log10p1(f'len({_TOKS})')} END AS ext_log_words,
         md5(text) AS key, {_PROFILE} AS profile
  FROM refs),
rfp0 AS (SELECT ref_id, key, profile, quality, toxic, log_chars, ext_log_len, ext_log_words,
                {_pattern_terms()} AS u0 FROM rsrc),
rfp AS (SELECT *, bit_count(u0)::INTEGER AS pc FROM rfp0),
qsrc AS (
  SELECT d.doc_id AS query_id, d.text, l.quality IS NULL AS is_test, l.quality::DOUBLE AS quality,
         l.toxic::DOUBLE AS toxic,
         CASE WHEN l.quality IS NOT NULL THEN {_log10p1('length(d.text)')} END AS log_chars,
         md5(d.text) AS key, {_PROFILE.replace('text', 'd.text')} AS profile
  FROM documents d LEFT JOIN labels l USING (doc_id)),
qfp0 AS (SELECT query_id, is_test, key, profile, quality, toxic, log_chars,
                {_pattern_terms()} AS u0 FROM qsrc),
qfp AS (SELECT *, bit_count(u0)::INTEGER AS pc FROM qfp0),
rlong AS (
  SELECT ref_id, 0 AS prop_ord, 'quality' AS property, quality AS value FROM rfp WHERE quality IS NOT NULL
  UNION ALL SELECT ref_id, 1, 'toxic', toxic FROM rfp WHERE toxic IS NOT NULL
  UNION ALL SELECT ref_id, 2, 'log_chars', log_chars FROM rfp WHERE log_chars IS NOT NULL
  UNION ALL SELECT ref_id, 3, 'ext_log_len', ext_log_len FROM rfp WHERE ext_log_len IS NOT NULL
  UNION ALL SELECT ref_id, 4, 'ext_log_words', ext_log_words FROM rfp WHERE ext_log_words IS NOT NULL),
qpairs AS (
  SELECT query_id, is_test, ref_id, inter, qpc + rpc - inter AS uni,
         (inter = qpc AND inter = rpc AND rpc > 0) AS ident
  FROM (SELECT q.query_id, q.is_test, r.ref_id, q.pc AS qpc, r.pc AS rpc,
               bit_count(q.u0 & r.u0)::INTEGER AS inter FROM qfp q, rfp r)),
topk AS (
  SELECT * FROM (
    SELECT p.query_id, l.prop_ord::INTEGER AS prop_ord, l.property, p.ref_id, p.inter / p.uni AS sim, l.value,
           row_number() OVER (PARTITION BY p.query_id, l.prop_ord ORDER BY p.inter / p.uni DESC, p.ref_id)
             AS rank
    FROM qpairs p JOIN rlong l USING (ref_id)
    WHERE p.uni > 0 AND (p.is_test OR NOT p.ident))
  WHERE rank <= CASE WHEN prop_ord < 3 THEN 5 ELSE 3 END)"""

_MERGE_BASE = """
nbk AS (SELECT t.*, r.key, r.profile FROM nb t JOIN rfp r USING (ref_id)),
perprop AS (
  SELECT query_id, key, prop_ord, property, profile, min(rank) AS first_rank,
         arg_max(ref_id, rank) AS last_ref, arg_max(value, rank) AS last_value, arg_max(sim, rank) AS last_sim
  FROM nbk GROUP BY query_id, key, prop_ord, property, profile)"""


def _merged_sql(jitter: bool) -> str:
    reps = "CROSS JOIN (SELECT range AS replica FROM range(10)) r" if jitter else \
        "CROSS JOIN (SELECT 0 AS replica) r"
    val = (f"last_value + {_gauss(chr(39) + '42' + chr(39) + ' || chr(58) || replica || chr(58) || query_id || chr(58) || property || chr(58) || last_ref', 0.02)}"
           if jitter else "last_value")
    return f"""{_MERGE_BASE},
pv AS (SELECT p.*, r.replica, {val} AS v FROM perprop p {reps}),
merged AS (
  SELECT replica, query_id, key, any_value(profile) AS profile, min(prop_ord) AS pos_prop,
         arg_min(first_rank, prop_ord) AS pos_rank, arg_max(last_sim, prop_ord) AS sim,
         string_agg(property || '=' || {_fmt2('v')}, ', ' ORDER BY prop_ord) AS props_text
  FROM pv GROUP BY replica, query_id, key)"""


SQL["topk_neighbours"] = f"""WITH {_REFS}, {_RQ}
SELECT query_id, prop_ord, property, rank::INTEGER AS rank, ref_id, round(sim, 6) AS sim,
       round(value, 6) AS value FROM topk"""

SQL["merge_neighbours"] = f"""WITH {_REFS}, {_RQ}, nb AS (SELECT * FROM topk), {_merged_sql(False)}
SELECT query_id, key, pos_prop, pos_rank::INTEGER AS pos_rank, round(sim, 6) AS sim, props_text FROM merged"""

_TARGETS = """tl AS (
  SELECT query_id, 0 AS prop_ord, 'quality' AS property, quality AS value FROM qfp WHERE NOT is_test AND quality IS NOT NULL
  UNION ALL SELECT query_id, 1, 'toxic', toxic FROM qfp WHERE NOT is_test AND toxic IS NOT NULL
  UNION ALL SELECT query_id, 2, 'log_chars', log_chars FROM qfp WHERE NOT is_test AND log_chars IS NOT NULL)"""
_JT = _gauss("'42' || chr(58) || replica || chr(58) || query_id || chr(58) || property || chr(58) || 'q'", 0.02)

SQL["training_targets"] = f"""WITH {_REFS}, {_RQ}, {_TARGETS}
SELECT query_id, property, round(value, 6) AS value FROM tl"""
SQL["replicated_targets"] = f"""WITH {_REFS}, {_RQ}, {_TARGETS}
SELECT replica::INTEGER AS replica, query_id, property, round(value + {_JT}, 6) AS value
FROM tl CROSS JOIN (SELECT range AS replica FROM range(10)) r"""


def _render_sql(train: bool) -> str:
    reps = "(SELECT range AS replica FROM range(10))" if train else "(SELECT 0 AS replica)"
    nb = ("nb AS (SELECT t.* FROM topk t JOIN qfp q USING (query_id) WHERE "
          + ("NOT q.is_test)" if train else "q.is_test)"))
    ctx = """ctx AS (
  SELECT replica, query_id,
         string_agg('KEY: ' || key || ', ' || profile || ', Similarity: ' || """ + _fmt2("sim") + \
        """ || ', ' || props_text, '; ' ORDER BY pos_prop, pos_rank) AS context
  FROM merged GROUP BY replica, query_id)"""
    qs = f"qs AS (SELECT q.*, r.replica FROM qfp q CROSS JOIN {reps} r WHERE " + \
         ("NOT q.is_test)" if train else "q.is_test)")
    if train:
        tgt = f""", tj AS (SELECT tl.*, r.replica, value + {_JT} AS v FROM tl CROSS JOIN {reps} r),
tg AS (SELECT replica, query_id, string_agg(property, ', ' ORDER BY prop_ord) AS names,
              string_agg(property || '=' || {_fmt2('v')}, ', ' ORDER BY prop_ord) AS answer
       FROM tj GROUP BY replica, query_id)"""
        sel = """SELECT qs.replica::INTEGER AS replica, qs.query_id, coalesce(c.context, '') AS context,
       'KEY: ' || qs.key || ', ' || qs.profile || '; Determine ' || coalesce(tg.names, '') AS question,
       coalesce(tg.answer, '') AS answer
FROM qs LEFT JOIN ctx c USING (replica, query_id) LEFT JOIN tg USING (replica, query_id)"""
        return f"WITH {_REFS}, {_RQ}, {_TARGETS}, {nb}, {_merged_sql(True)}, {ctx}, {qs}{tgt} {sel}"
    sel = """SELECT qs.query_id, coalesce(c.context, '') AS context,
       'KEY: ' || qs.key || ', ' || qs.profile || '; Determine quality, toxic, log_chars' AS question
FROM qs LEFT JOIN ctx c USING (replica, query_id)"""
    return f"WITH {_REFS}, {_RQ}, {nb}, {_merged_sql(False)}, {ctx}, {qs} {sel}"


SQL["render_prompts"] = _render_sql(True)
SQL["test_prompts"] = _render_sql(False)
SQL["chat_jsonl"] = ("SELECT context, question, answer, 2 AS n_turns, true AS no_system FROM ("
                     + _render_sql(True) + ")")


# --- hooks and streaming ---------------------------------------------------------

SQL["group_stream_hook"] = """SELECT l_returnflag, count(*)::BIGINT AS n, round(coalesce(sum(abs(q - p)), 0), 6) AS path
FROM (SELECT l_returnflag, l_quantity AS q,
        lag(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_quantity) AS p FROM lineitem)
GROUP BY l_returnflag"""
SQL["group_reduce_hook"] = """SELECT l_linestatus, l_returnflag, count(*)::BIGINT AS n,
  round(max(l_extendedprice) - min(l_extendedprice), 6) AS span FROM lineitem GROUP BY 1, 2"""
SQL["udf_batch_hook"] = """SELECT doc_id,
  (length(text) - length(regexp_replace(text, '[aeiou]', '', 'g')))::BIGINT AS n_vowels FROM documents"""
SQL["map_batches_hook"] = """SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM documents"""
SQL["stream_parse_answers"] = SQL["parse_answers"]


# --- reports ------------------------------------------------------------------

SQL["head_ordered"] = f"""
WITH {_M}
SELECT {_ORDER}, l_quantity, group_size FROM (
  SELECT {_ORDER}, l_quantity, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS group_size FROM m)
WHERE group_size > 1
ORDER BY l_partkey, l_suppkey, {_ORDER} LIMIT 10"""
SQL["last_identical_pair"] = f"""WITH {_FPW}, {_TT}, {_IDENT}
SELECT i, j FROM ident ORDER BY i DESC, j DESC LIMIT 1"""
SQL["stage_shapes"] = f"""
WITH {_M}
SELECT 'measurements' AS stage, count(*)::BIGINT AS n_rows, 10::BIGINT AS n_cols FROM m
UNION ALL
SELECT 'duplicate_members', count(*)::BIGINT, 11::BIGINT FROM (
  SELECT count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS g FROM m) WHERE g > 1
UNION ALL
SELECT 'consensus', count(*)::BIGINT, 14::BIGINT FROM (SELECT DISTINCT l_partkey, l_suppkey FROM m)"""
SQL["fold_files"] = f"WITH {_FOLDS} SELECT * FROM kf"
