"""DuckDB SQL for the registered queries, written from the formulas and not from the Spark plans.

Fragments shared by several queries are common table expressions built by small functions. Results are
rounded to six places (a few to four or two), as the Spark side is.
"""

from __future__ import annotations

import math

from checks.queries import GRID, PHRASES, SIZES, TABLES, WIDE
from slicewise.functions import constants as K

COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount "
    "l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
LABEL_COLUMNS = {
    "region": "r_name",
    "nation": "n_name",
    "customer": "c_name c_mktsegment",
    "supplier": "s_name",
    "part": "p_name p_brand p_type",
    "orders": "o_orderstatus o_orderdate o_orderpriority",
    "lineitem": "l_returnflag l_linestatus l_shipdate",
    "events": "ts event_type props",
    "documents": "text lang source",
    "pages": "url html",
    "benchmark": "text",
    "conversations": "role text",
}
BLANKS = "||".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rnd(expr: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({expr}, {digits}) AS {name or expr}"


def key_md5(*keys: str) -> str:
    return "md5(" + " || ".join(f"coalesce(length({k}::VARCHAR)::VARCHAR || ':' || {k}::VARCHAR, 'n')" for k in keys) + ")"


def strings(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def tier(expr: str, tiers: dict, default: str = "CRITICAL") -> str:
    whens = " ".join(
        f"WHEN {expr} < {c} THEN '{label}'" for label, c in sorted(tiers.items(), key=lambda t: t[1])
    )
    return f"CASE WHEN {expr} IS NULL THEN 'UNKNOWN' {whens} ELSE '{default}' END"


def grade(expr: str) -> str:
    return (
        f"CASE WHEN {expr} >= 85 THEN 'A' WHEN {expr} >= 70 THEN 'B' WHEN {expr} >= 55 THEN 'C' "
        f"WHEN {expr} >= 40 THEN 'D' ELSE 'F' END"
    )


def clamp(expr: str) -> str:
    return f"least(100.0::DOUBLE, greatest(0.0::DOUBLE, {expr}))"


# ---- input variants

LINEITEM = """(SELECT l_orderkey, l_partkey, l_suppkey, nullif(l_linenumber, 7) AS l_linenumber,
  CASE WHEN l_quantity <> 23 THEN l_quantity END AS l_quantity, l_extendedprice, l_discount,
  CASE WHEN l_tax < 0.08::DOUBLE THEN l_tax END AS l_tax, l_returnflag, l_linestatus, l_shipdate,
  NULL::VARCHAR AS l_comment FROM lineitem)"""
EVENTS = """(SELECT event_id, ts, user_id, event_type, CASE WHEN value >= 20 THEN value END AS value, props
  FROM events)"""
ORDERS = "(SELECT year(o_orderdate)::INTEGER AS year, o_orderstatus, o_orderpriority FROM orders)"
SKEWED = f"""(SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'normal' END AS urgency,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'late' ELSE 'fine' END AS delay
  FROM {ORDERS})"""
LINEITEM_COLUMNS = [
    *[c for c in COLUMNS["lineitem"].split() if c != "l_linestatus"],
    "l_comment",
]
CORPORA = """(SELECT 'documents/' || lang AS corpus, text FROM documents
  UNION ALL SELECT 'conversations/' || role, text FROM conversations
  UNION ALL SELECT 'benchmark/all', text FROM benchmark
  UNION ALL SELECT 'pages/all', html FROM pages)"""


def unpivot(source: str, columns, by: str = "", cast: str = "DOUBLE") -> str:
    """Rows (by, column, value) with one SELECT per column."""
    by = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {by}'{c}' AS \"column\", CAST({c} AS {cast}) AS value FROM {source}" for c in columns
    )


def lines_cte(source: str, key: str) -> str:
    """CTEs raw(key, line) of all lines and lines(key, line, …) of the stripped non-blank ones."""
    return f"""
    parts AS (SELECT {key}, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS p
              FROM {source}),
    raw AS (SELECT {key}, unnest(CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END) AS line FROM parts),
    lines AS (SELECT {key}, line, length(line) AS len,
                len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) AS words
              FROM (SELECT {key}, trim(line, {BLANKS}) AS line FROM raw) WHERE line <> ''),
    chars AS (SELECT {key}, sum(length(text))::BIGINT AS char_count FROM {source} GROUP BY {key})"""


ENTROPY = (
    "list_sum(list_transform(list_distinct(string_split(line, '')), lambda c: "
    "-((length(line) - length(replace(line, c, ''))) / length(line)) "
    "* log2((length(line) - length(replace(line, c, ''))) / length(line))))"
)
HIT = " OR ".join(f"contains(lower(line), {quote(p)})" for p in PHRASES)


def text_cte(source: str, key: str) -> str:
    """CTE prof: the text profile per slice."""
    return f"""{lines_cte(source, key)},
    summ AS (SELECT {key}, count(*) AS line_count, count(*) FILTER (WHERE {HIT}) AS phrase_hits FROM raw GROUP BY {key}),
    stat AS (SELECT {key}, count(*) AS sampled_lines, count(DISTINCT line) AS unique_lines, avg(len) AS avg_line_length,
               max(len) AS max_line_length, min(len) AS min_line_length, avg(words) AS avg_word_count,
               stddev_pop(len) AS std_length, count(*) FILTER (WHERE {ENTROPY} < 2.0) AS low_entropy_lines
             FROM lines GROUP BY {key}),
    outl AS (SELECT l.{key}, count(*) FILTER (WHERE abs((len - avg_line_length) / (std_length + 1e-9::DOUBLE)) > 3) AS outlier_lines
             FROM lines l JOIN stat s ON l.{key} = s.{key} GROUP BY l.{key}),
    voc AS (SELECT {key}, count(*) AS word_count, count(DISTINCT w) AS vocab_size FROM
             (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower(line), '\\s+'), lambda w: w <> '')) AS w FROM lines)
            GROUP BY {key}),
    prof AS (SELECT stat.{key}, line_count, char_count, sampled_lines, unique_lines, avg_line_length, max_line_length,
               min_line_length, avg_word_count, std_length, outlier_lines, low_entropy_lines, phrase_hits, word_count, vocab_size,
               vocab_size / word_count AS type_token_ratio, sampled_lines - unique_lines AS duplicate_lines,
               (sampled_lines - unique_lines) / sampled_lines * 100.0::DOUBLE AS duplicate_pct,
               outlier_lines / sampled_lines * 100.0::DOUBLE AS outlier_pct,
               low_entropy_lines / sampled_lines * 100.0::DOUBLE AS low_entropy_pct,
               char_count / line_count AS avg_raw_length, floor(char_count / 4)::BIGINT AS estimated_tokens
             FROM stat JOIN summ ON stat.{key} = summ.{key} JOIN outl ON stat.{key} = outl.{key}
             JOIN voc ON stat.{key} = voc.{key} JOIN chars ON stat.{key} = chars.{key})"""


def score_text_cte(source: str, key: str) -> str:
    """CTE card: text profile with quality, vulnerability, fairness and contamination."""
    n = "sampled_lines"
    prints = [p for p in K.BENCHMARK_PRINTS if p[1] > 0]
    matches = " + ".join(
        f"(line_count BETWEEN {a} AND {b} AND avg_raw_length BETWEEN {c} AND {d})::INT"
        for _, a, b, c, d in prints
    )
    return f"""{text_cte(source, key)},
    dims AS (SELECT *, 95.0::DOUBLE AS completeness, {clamp("100.0::DOUBLE - duplicate_pct * 2.2::DOUBLE")} AS duplication,
               {clamp("ln(1 + type_token_ratio * 20) / ln(11) * 100")} AS vocabulary_diversity,
               CASE WHEN max_line_length > avg_line_length * 12 THEN 60.0::DOUBLE ELSE 82.0::DOUBLE END AS noise,
               CASE WHEN {n} < 1000 THEN 0.0::DOUBLE WHEN {n} < 10000 THEN 10 + ({n} - 1000) / 9000.0::DOUBLE * 35
                    WHEN {n} < 100000 THEN 45 + ({n} - 10000) / 90000.0::DOUBLE * 30
                    WHEN {n} < 1000000 THEN 75 + ({n} - 100000) / 900000.0::DOUBLE * 20 ELSE 100.0::DOUBLE END AS structural_integrity,
               {clamp("outlier_pct * 4 + low_entropy_pct * 2")} AS vulnerability_score,
               {clamp("100.0::DOUBLE - type_token_ratio * 150 + duplicate_pct")} AS drift_score,
               ({matches}) AS fingerprint_matches FROM prof),
    tot AS (SELECT *, {clamp("completeness * 0.2::DOUBLE + duplication * 0.25::DOUBLE + vocabulary_diversity * 0.25::DOUBLE + noise * 0.1::DOUBLE + structural_integrity * 0.2::DOUBLE")} AS t,
              {clamp("fingerprint_matches * 30.0::DOUBLE + phrase_hits * 10.0::DOUBLE")} AS contamination_score FROM dims),
    card AS (SELECT *, CASE WHEN {n} < 1000 THEN least(t, 20.0::DOUBLE) WHEN {n} < 10000 THEN least(t, 50.0::DOUBLE) ELSE t END AS total_score,
              {tier("vulnerability_score", K.VULNERABILITY_TIERS)} AS vulnerability_level,
              {tier("drift_score", K.FAIRNESS_TIERS)} AS drift_level,
              {tier("contamination_score", K.CONTAMINATION_TIERS)} AS contamination_level,
              estimated_tokens AS token_count FROM tot)"""


def scenario_values(scenarios: list[dict]) -> str:
    rows = []
    for s in scenarios:
        full = {**K.SCENARIO_DEFAULTS, **s}
        rows.append(
            "(" + ", ".join(quote(full[f]) for f in list(K.SCENARIO_DEFAULTS)[:5])
            + f", {float(full['param_count_millions'])}::DOUBLE)"
        )
    fields = ", ".join(K.SCENARIO_DEFAULTS)
    return f"scen AS (SELECT * FROM (VALUES {', '.join(rows)}) v({fields}))"


def lookup(pairs, name: str) -> str:
    return f"CASE {' '.join(f'WHEN {cond} THEN {value}' for cond, value in pairs)} END AS {name}"


def scenario_cte(kind: str, severity: str = "'NONE'") -> str:
    """CTEs from card × scen: res with compatibility, cost and memorization. Column scope: x."""
    params = " ".join(
        f"WHEN model_size = '{size}' AND ai_type = '{ai}' THEN {value}::DOUBLE"
        for size, t in K.MODEL_PARAMS_M.items()
        for ai, value in t.items()
    )
    params += " " + " ".join(
        f"WHEN model_size = '{size}' THEN {t['NLP']}::DOUBLE" for size, t in K.MODEL_PARAMS_M.items()
    )
    kinds = " OR ".join(
        f"(ai_type = '{ai}' AND '{kind}' IN ({', '.join(map(quote, v))}))" for ai, v in K.ACCEPTED_KINDS.items()
    )
    tasks = " OR ".join(
        f"(architecture = '{a}' AND task_type IN ({', '.join(map(quote, v))}))" for a, v in K.ARCHITECTURE_TASKS.items()
    )
    slot = 0 if kind == "tabular" else 1
    size = "row_count" if kind == "tabular" else "token_count"
    needs = " ".join(f"WHEN model_size = '{m}' THEN {v[slot]}" for m, v in K.SIZE_NEEDS.items())
    quality = " ".join(f"WHEN domain = '{d}' THEN {v}" for d, v in K.DOMAIN_QUALITY.items())
    big, mid = (1_000_000, 50_000) if kind == "tabular" else (500_000_000, 25_000_000)
    return f"""
    x0 AS (SELECT card.*, scen.*, {severity} AS mismatch_severity, CASE {params} END AS model_params_millions,
             CASE WHEN {kinds} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS type_fit,
             CASE WHEN {tasks} THEN 100.0::DOUBLE ELSE 30.0::DOUBLE END AS architecture_fit,
             {size}::BIGINT AS data_size, (CASE {needs} END)::BIGINT AS required_size,
             (CASE {quality} ELSE 60 END)::DOUBLE AS wanted FROM card CROSS JOIN scen),
    x1 AS (SELECT *, {clamp("data_size / required_size * 100")} AS size_fit,
             CASE WHEN total_score >= wanted THEN 100.0::DOUBLE ELSE {clamp("pow(total_score / wanted, 2.5::DOUBLE) * 100")} END AS quality_fit,
             token_count / (model_params_millions * 1e6::DOUBLE * 20) AS chinchilla_ratio,
             6.0::DOUBLE * token_count * model_params_millions * 1e6::DOUBLE AS total_flops,
             token_count / greatest(param_count_millions * 1e6::DOUBLE, 1) AS token_to_param_ratio FROM x0),
    x2 AS (SELECT *, type_fit * 0.3::DOUBLE + architecture_fit * 0.3::DOUBLE + size_fit * 0.15::DOUBLE + quality_fit * 0.25::DOUBLE AS f0,
             token_to_param_ratio / (1 + duplicate_pct / 100 * 2) AS effective_ratio, total_flops / 1e15::DOUBLE AS total_pflops,
             CASE WHEN token_count = 0 OR chinchilla_ratio < 0.1 THEN 'CRITICALLY_INSUFFICIENT' WHEN chinchilla_ratio < 0.5 THEN 'INSUFFICIENT'
                  WHEN chinchilla_ratio < 1 THEN 'MARGINAL' ELSE 'SUFFICIENT' END AS data_sufficiency FROM x1),
    x3 AS (SELECT *, CASE WHEN type_fit = 0 THEN least(f0, 35.0::DOUBLE) ELSE f0 END AS fit,
             1 / (1 + exp(0.8::DOUBLE * ln(greatest(effective_ratio, 1e-6::DOUBLE)))) AS memorization_probability,
             {tier("effective_ratio", K.MEMORIZATION_TIERS, "MINIMAL")} AS memorization_level FROM x2),
    res AS (SELECT *, fit * CASE WHEN mismatch_severity = 'HIGH' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS compatibility_score,
             memorization_probability * 100 AS leakage_score, memorization_level IN ('CRITICAL', 'HIGH') AS privacy_flag,
             CASE WHEN fit >= 75 THEN 'SUITABLE' WHEN fit >= 45 THEN 'PARTIALLY_SUITABLE' ELSE 'NOT_SUITABLE' END AS suitability,
             CASE WHEN size_fit >= 100 THEN 'ENOUGH' WHEN size_fit >= 50 THEN 'MARGINAL' ELSE 'NOT_ENOUGH' END AS size_verdict,
             {"'Recommendation'" if kind == "tabular" else "'NLP'"} AS best_ai_type,
             CASE WHEN data_size > {big} THEN 'Large' WHEN data_size > {mid} THEN 'Medium' ELSE 'Small' END AS best_model_size FROM x3)"""


# (code, severity, condition, value) of the findings in a result row.
TEXT_FINDINGS = [
    ("DUPLICATE_LINES", "warning", "duplicate_pct > 10", "duplicate_pct"),
    ("LOW_DIVERSITY", "warning", "type_token_ratio < 0.15", "type_token_ratio"),
    ("EXTREME_LENGTH", "warning", "max_line_length > avg_line_length * 12", "max_line_length / avg_line_length"),
    ("TOO_SMALL", "critical", "sampled_lines < 1000", "sampled_lines"),
    ("SMALL", "warning", "sampled_lines BETWEEN 1000 AND 9999", "sampled_lines"),
    (
        "QUALITY_OK",
        "info",
        "NOT (duplicate_pct > 10 OR type_token_ratio < 0.15 OR max_line_length > avg_line_length * 12 OR sampled_lines < 10000)",
        "NULL",
    ),
    ("LENGTH_OUTLIERS", "warning", "outlier_pct > 1", "outlier_pct"),
    ("LOW_ENTROPY", "warning", "low_entropy_pct > 5", "low_entropy_pct"),
    ("NARROW_VOCABULARY", "warning", "type_token_ratio < 0.15", "type_token_ratio"),
    ("REPEATED_CONTENT", "warning", "duplicate_pct > 15", "duplicate_pct"),
    ("BENCHMARK_PRINT", "warning", "fingerprint_matches > 0", "fingerprint_matches"),
    ("SMALL_CORPUS", "warning", "token_count < 1000000", "token_count"),
]
TABLE_FINDINGS = [
    ("MISSING_VALUES", "warning", "avg_missing_pct > 5", "avg_missing_pct"),
    ("DUPLICATE_ROWS", "warning", "duplicate_pct > 2", "duplicate_pct"),
    ("NOISE", "warning", "avg_noise > 0.7", "avg_noise"),
    ("TOO_SMALL", "critical", "row_count < 10", "row_count"),
    ("VERY_SMALL", "warning", "row_count BETWEEN 10 AND 99", "row_count"),
    ("SMALL", "warning", "row_count BETWEEN 100 AND 999", "row_count"),
    ("MODERATE_SIZE", "warning", "row_count BETWEEN 1000 AND 9999", "row_count"),
    ("GEOMETRIC_OUTLIERS", "warning", "outlier_pct > 2", "outlier_pct"),
    ("ISOLATED_POINTS", "warning", "isolated_pct > 5", "isolated_pct"),
]
SHARED_FINDINGS = [
    ("FEW_TOKENS_PER_PARAMETER", "warning", "memorization_level IN ('CRITICAL', 'HIGH')", "effective_ratio"),
    ("MODERATE_TOKENS_PER_PARAMETER", "warning", "memorization_level = 'MEDIUM'", "effective_ratio"),
    ("DUPLICATION_AMPLIFIES", "warning", "duplicate_pct > 5", "duplicate_pct"),
    ("DOMAIN_MISMATCH", "critical", "mismatch_severity <> 'NONE'", "fit"),
    ("KIND_MISMATCH", "critical", "type_fit = 0", "0"),
    ("ARCHITECTURE_MISMATCH", "critical", "architecture_fit < 100", "architecture_fit"),
    ("INSUFFICIENT_DATA", "critical", "size_fit < 50", "size_fit"),
    ("MARGINAL_DATA", "warning", "size_fit >= 50 AND size_fit < 100", "size_fit"),
    ("QUALITY_BELOW_DOMAIN", "warning", "quality_fit < 100", "total_score"),
    ("DOMAIN_PENALTY", "critical", "mismatch_severity = 'HIGH'", "compatibility_score"),
    (
        "COMPATIBILITY_OK",
        "info",
        "mismatch_severity = 'NONE' AND type_fit > 0 AND architecture_fit = 100 AND size_fit >= 100 AND quality_fit = 100",
        "NULL",
    ),
]


def finding_counts(findings, severity: str) -> str:
    return " + ".join(f"({cond})::INT" for _, s, cond, _ in findings if s == severity)


def card_select(keys: list[str], findings) -> str:
    """The scorecard row from res (with extra findings columns already in scope)."""
    from checks.queries import AUDIT_COLUMNS

    numbers = {
        "total_score", "vulnerability_score", "leakage_score", "drift_score", "contamination_score",
        "average_risk", "compatibility_score", "domain_confidence",
    }
    columns = [rnd(c) if c in numbers else c for c in [*keys, *AUDIT_COLUMNS]]
    error = "sqrt(100 / ci_n)"
    return f"""
    s1 AS (SELECT *, ({finding_counts(findings, "critical")})::BIGINT AS critical_issues,
             ({finding_counts(findings, "warning")})::BIGINT AS warnings,
             (coalesce(vulnerability_score, 0) + leakage_score + drift_score + contamination_score) / 4 AS average_risk FROM res),
    s2 AS (SELECT *, {tier("average_risk", K.OVERALL_TIERS)} AS overall_risk_level, {grade("total_score")} AS grade FROM s1),
    s3 AS (SELECT *, CASE WHEN critical_issues > 0 THEN 'NOT_READY'
             WHEN compatibility_score >= 75 AND total_score >= 70 AND overall_risk_level IN ('LOW', 'MEDIUM') THEN 'READY'
             WHEN compatibility_score >= 50 OR total_score >= 55 THEN 'CONDITIONALLY_READY' ELSE 'NOT_READY' END AS verdict FROM s2)
    SELECT {", ".join(columns)},
      round(greatest(0, vulnerability_score - {K.Z_95}::DOUBLE * {error}), 6) AS adversarial_low,
      round(least(100, vulnerability_score + {K.Z_95}::DOUBLE * {error}), 6) AS adversarial_high FROM s3"""


# ---- tables


def histogram_cte(source_rows: str, by: str) -> str:
    """CTE hist(by, column, bin, bin_lo, bin_hi, n) over rows (by, column, value)."""
    b = f"{by}, " if by else ""
    join = f"v.{by} = e.{by} AND " if by else ""
    group = f'{b}"column"'
    return f"""
    vals AS (SELECT * FROM ({source_rows}) WHERE value IS NOT NULL),
    rng AS (SELECT {group}, min(value) AS lo0, max(value) AS hi0 FROM vals GROUP BY {group} HAVING count(*) >= 2),
    edges AS (SELECT {group}, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM rng),
    binned AS (SELECT {", ".join("v." + c for c in ([by] if by else []) + ['"column"'])},
                 1 + len(list_filter(range(1, 30), lambda i: v.value >= e.lo + i * ((e.hi - e.lo) / 30))) AS bin
               FROM vals v JOIN edges e ON {join}v."column" = e."column"),
    cnt AS (SELECT {group}, bin, count(*) AS n FROM binned GROUP BY {group}, bin),
    hist AS (SELECT {", ".join("e." + c for c in ([by] if by else []) + ['"column"'])}, b.bin::INTEGER AS bin,
               e.lo + (b.bin - 1) * ((e.hi - e.lo) / 30) AS bin_lo,
               CASE WHEN b.bin = 30 THEN e.hi ELSE e.lo + b.bin * ((e.hi - e.lo) / 30) END AS bin_hi, coalesce(c.n, 0)::BIGINT AS n
             FROM edges e CROSS JOIN (SELECT unnest(range(1, 31)) AS bin) b
             LEFT JOIN cnt c ON {"c." + by + " = e." + by + " AND " if by else ""}c."column" = e."column" AND c.bin = b.bin)"""


def balance_cte(source_rows: str, by: str, top: int = 20) -> str:
    """CTEs cb (top labels) and bm (metrics of all labels) over rows (by, column, value)."""
    b = f"{by}, " if by else ""
    group = f'{b}"column"'
    return f"""
    labs AS (SELECT {group}, value AS label, count(*) AS n FROM ({source_rows}) WHERE value IS NOT NULL GROUP BY {group}, value),
    ranked AS (SELECT *, n / sum(n) OVER (PARTITION BY {group}) AS proportion,
                 row_number() OVER (PARTITION BY {group} ORDER BY n DESC, label) AS rank FROM labs),
    cb AS (SELECT {group}, label, n, proportion, rank::INTEGER AS rank FROM ranked WHERE rank <= {top}),
    bm AS (SELECT {group}, count(*) AS n_classes, max(proportion) AS max_prop, min(proportion) AS min_prop,
             1 - sum(proportion * proportion) AS gini, -sum(proportion * log2(proportion)) AS entropy,
             -sum(proportion * log2(proportion)) / CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1 END AS entropy_ratio
           FROM ranked GROUP BY {group})"""


def table_quality_cte(
    source: str, by: str, numeric: list[str], categorical: list[str], everything: list[str], columns: str
) -> str:
    """CTE tq(by, row_count, column_count, …, total_score, grade). ``columns`` is the column count."""
    gaps = " UNION ALL ".join(
        f"SELECT {by}, (count(*) - count({c})) / count(*) * 100.0::DOUBLE AS pct FROM {source} GROUP BY {by}"
        for c in everything
    )
    r = "row_count"
    return f"""{histogram_cte(unpivot(source, numeric, by), by)},
    {balance_cte(unpivot(source, categorical, by, "VARCHAR"), by) if categorical else f"bm AS (SELECT NULL AS {by}, NULL AS max_prop, NULL AS entropy_ratio WHERE false)"},
    mom AS (SELECT {by}, "column", avg(value) AS mean, stddev_samp(value) AS std, max(value) > min(value) AS spread FROM vals GROUP BY ALL),
    nz AS (SELECT m.{by}, m."column", any_value(mean) AS mean, any_value(std) AS std,
             coalesce(sum(h.n) FILTER (WHERE bin_hi < mean - 3 * (std + 1e-9::DOUBLE) OR bin_lo > mean + 3 * (std + 1e-9::DOUBLE)), 0) / sum(h.n) AS outlier_frac,
             CASE WHEN abs(any_value(mean)) > 1e-12::DOUBLE THEN any_value(std) / abs(any_value(mean)) ELSE 1.5::DOUBLE END AS cv
           FROM mom m JOIN hist h ON m.{by} = h.{by} AND m."column" = h."column" WHERE spread GROUP BY m.{by}, m."column"),
    nn AS (SELECT *, least(0.7::DOUBLE * least(cv, 2) + 3 * outlier_frac, 1.5::DOUBLE) AS noise FROM nz),
    nzs AS (SELECT {by}, avg(noise) AS avg_noise FROM nn GROUP BY {by}),
    bms AS (SELECT {by}, avg(max_prop) AS am, avg(entropy_ratio) AS ae FROM bm GROUP BY {by}),
    gap AS (SELECT {by}, avg(pct) AS avg_missing_pct, max(pct) AS max_missing_pct FROM ({gaps}) GROUP BY {by}),
    dup AS (SELECT {by}, sum(n)::BIGINT AS row_count, (sum(n) - count(*))::BIGINT AS duplicate_count FROM
             (SELECT {by}, count(*) AS n FROM {source} GROUP BY {by}, {", ".join(everything)}) GROUP BY {by}),
    d1 AS (SELECT dup.{by}, row_count, ({columns})::BIGINT AS column_count, avg_missing_pct, max_missing_pct, duplicate_count,
             duplicate_count / row_count * 100.0::DOUBLE AS duplicate_pct, coalesce(avg_noise, 0) AS avg_noise, am, ae
           FROM dup JOIN gap ON dup.{by} = gap.{by} LEFT JOIN nzs ON dup.{by} = nzs.{by} LEFT JOIN bms ON dup.{by} = bms.{by}),
    d2 AS (SELECT *, {clamp("100.0::DOUBLE - 1.8::DOUBLE * avg_missing_pct - CASE WHEN max_missing_pct > 50 THEN 8 ELSE 0 END")} AS completeness,
             CASE WHEN duplicate_pct <= 2 THEN 100 - 2 * duplicate_pct ELSE {clamp("96.0::DOUBLE - 4 * pow(duplicate_pct - 2, 1.4::DOUBLE)")} END AS duplication,
             {clamp("100.0::DOUBLE - 22 * avg_noise")} AS noise,
             CASE WHEN am IS NULL THEN 100.0::DOUBLE ELSE {clamp("100.0::DOUBLE - 380 * pow(greatest(0, am - 0.5), 1.5::DOUBLE) + 5 * ae")} END AS balance,
             least(10.0::DOUBLE, 2.5::DOUBLE * log2(column_count)) AS bonus FROM d1),
    d3 AS (SELECT *, CASE WHEN {r} < 10 THEN 0.0::DOUBLE WHEN {r} < 100 THEN 10.0::DOUBLE
             WHEN {r} < 1000 THEN {clamp(f"10 + ({r} - 100) / 900.0::DOUBLE * 35 + 0.3::DOUBLE * bonus")}
             WHEN {r} < 10000 THEN {clamp(f"45 + ({r} - 1000) / 9000.0::DOUBLE * 30 + 0.5::DOUBLE * bonus")}
             WHEN {r} < 100000 THEN {clamp(f"75 + ({r} - 10000) / 90000.0::DOUBLE * 20 + 0.3::DOUBLE * bonus")}
             ELSE 100.0::DOUBLE END AS structural_integrity FROM d2),
    d4 AS (SELECT *, {clamp("completeness * 0.2::DOUBLE + duplication * 0.15::DOUBLE + noise * 0.15::DOUBLE + balance * 0.2::DOUBLE + structural_integrity * 0.3::DOUBLE")} AS t FROM d3),
    d5 AS (SELECT *, CASE WHEN {r} < 10 THEN least(t, 20.0::DOUBLE) WHEN {r} < 100 THEN least(t, 45.0::DOUBLE) WHEN {r} < 1000 THEN least(t, 65.0::DOUBLE) ELSE t END AS total_score FROM d4),
    tq AS (SELECT *, {grade("total_score")} AS grade FROM d5)"""


TQ_COLUMNS = (
    "row_count, column_count, round(avg_missing_pct, 6) AS avg_missing_pct, round(max_missing_pct, 6) AS max_missing_pct, "
    "duplicate_count, round(duplicate_pct, 6) AS duplicate_pct, round(avg_noise, 6) AS avg_noise, round(noise, 6) AS noise, "
    "round(balance, 6) AS balance, round(completeness, 6) AS completeness, round(duplication, 6) AS duplication, "
    "round(structural_integrity, 6) AS structural_integrity, round(total_score, 6) AS total_score, grade"
)
EVENT_COLUMNS = ["event_id", "ts", "user_id", "value", "props"]


def event_quality() -> str:
    return table_quality_cte(
        EVENTS, "event_type", ["event_id", "user_id", "value"], ["ts", "props"], EVENT_COLUMNS, "6"
    )


def geometry_cte(points: str, by: str) -> str:
    """CTE geo(by, vectors, …) over rows (by, k, vec), where k is the md5 order and vec a list."""
    return f"""
    ord AS (SELECT {by}, vec, row_number() OVER (PARTITION BY {by} ORDER BY k, k2) AS rk FROM ({points})),
    smp AS (SELECT * FROM ord WHERE vec IS NOT NULL),
    cells AS (SELECT {by}, rk, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM smp),
    scl AS (SELECT {by}, dim, avg(x) AS mu, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sd FROM cells
            GROUP BY {by}, dim HAVING count(x) = count(*)),
    z AS MATERIALIZED (SELECT c.{by}, rk, list((x - mu) / sd ORDER BY c.dim) AS v FROM cells c JOIN scl s ON c.{by} = s.{by} AND c.dim = s.dim
          GROUP BY c.{by}, rk),
    nd AS (SELECT a.{by}, a.rk, min(list_distance(a.v, b.v)) AS d FROM (SELECT * FROM z WHERE rk <= 500) a JOIN z b ON a.{by} = b.{by} AND a.rk <> b.rk GROUP BY a.{by}, a.rk),
    mm AS (SELECT {by}, avg(d) AS m, stddev_pop(d) AS s, quantile_cont(d, 0.95) AS p95 FROM nd GROUP BY {by}),
    oc AS (SELECT nd.{by}, count(*) AS samples_analyzed, count(*) FILTER (WHERE abs((d - m) / (s + 1e-9::DOUBLE)) > 3) AS outlier_count,
             count(*) FILTER (WHERE d > p95) AS isolated FROM nd JOIN mm ON nd.{by} = mm.{by} GROUP BY nd.{by}),
    sz AS (SELECT {by}, count(vec) AS vectors, count(*) - count(vec) AS missing_vectors FROM ord GROUP BY {by}),
    g0 AS (SELECT sz.{by}, vectors, missing_vectors, CASE WHEN vectors >= 50 THEN samples_analyzed END AS samples_analyzed,
             CASE WHEN vectors >= 50 THEN outlier_count END AS outlier_count,
             CASE WHEN vectors >= 50 THEN outlier_count / samples_analyzed * 100.0::DOUBLE END AS outlier_pct,
             CASE WHEN vectors >= 50 THEN isolated / samples_analyzed * 100.0::DOUBLE END AS isolated_pct
           FROM sz LEFT JOIN oc ON sz.{by} = oc.{by}),
    g1 AS (SELECT *, CASE WHEN outlier_pct IS NOT NULL THEN {clamp("outlier_pct * 5 + isolated_pct * 2")} END AS vulnerability_score FROM g0),
    geo AS (SELECT *, {tier("vulnerability_score", K.VULNERABILITY_TIERS)} AS vulnerability_level FROM g1)"""


GEO_COLUMNS = (
    "vectors, missing_vectors, samples_analyzed, outlier_count, round(outlier_pct, 6) AS outlier_pct, round(isolated_pct, 6) AS isolated_pct, "
    "round(vulnerability_score, 6) AS vulnerability_score, vulnerability_level"
)


def shingles_cte(table: str, keep: str, n: str = "(5), (8), (13)") -> str:
    """Rows (keep, r, n, s) of the distinct n-word runs of every text of a table, with its row number."""
    return f"""SELECT DISTINCT {keep}, r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
      FROM (SELECT {keep}, row_number() OVER () AS r, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM {table}),
        (VALUES {n}) AS sizes(n) WHERE len(w) >= n"""


def overlap_cte() -> str:
    return f"""ds AS MATERIALIZED ({shingles_cte("documents", "doc_id, source")}), bs AS MATERIALIZED ({shingles_cte("benchmark", "item_id")}),
      size AS (SELECT item_id, n, count(*) AS item_shingles FROM bs GROUP BY item_id, n)"""


# ---- domains


def signature_cte() -> str:
    names, values = [], []
    for i, (domain, (weight, n, v)) in enumerate(K.DOMAIN_SIGNATURES.items()):
        names += [f"({quote(domain)}, {i}, {weight}::DOUBLE, {quote(w)})" for w in n]
        values += [f"({quote(domain)}, {i}, {weight}::DOUBLE, {quote(w)})" for w in v]
    domains = ", ".join(f"({quote(d)}, {i})" for i, d in enumerate(K.DOMAINS))
    return f"""
    nkw(domain, pos, weight, kw) AS (VALUES {", ".join(names)}),
    vkw(domain, pos, weight, kw) AS (VALUES {", ".join(values)}),
    doms(domain, pos) AS (VALUES {domains})"""


def catalog_cte() -> str:
    rows = ", ".join(f"({quote(t)}, {quote(c)})" for t in TABLES for c in COLUMNS[t].split())
    return f"cat(dataset, col) AS (VALUES {rows})"


def all_values() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, lower({c}::VARCHAR) AS value FROM {t}"
        for t, columns in LABEL_COLUMNS.items()
        for c in columns.split()
    )


def domain_cte(key: str, values: str) -> str:
    """CTE ds(key, domain, score, confidence, rank, hits) from cat(key, col) and rows (key, value)."""
    return f"""{signature_cte()},
    exact AS (SELECT c.{key}, c.col, k.domain, any_value(weight) * count(*) * 2 AS pts FROM
               (SELECT {key}, col, unnest(list_distinct(regexp_split_to_array(lower(col), '[_\\-\\s\\.]+'))) AS tok FROM cat) c
              JOIN nkw k ON c.tok = k.kw GROUP BY c.{key}, c.col, k.domain),
    inside AS (SELECT DISTINCT c.{key}, c.col, k.domain, weight AS pts FROM cat c JOIN nkw k ON contains(lower(c.col), k.kw)),
    pts AS (SELECT p.{key}, p.col, p.domain, coalesce(e.pts, p.pts) AS pts FROM inside p
            LEFT JOIN exact e ON p.{key} = e.{key} AND p.col = e.col AND p.domain = e.domain),
    toks AS (SELECT {key}, lower(col) AS value FROM cat UNION SELECT {key}, lower(value) FROM ({values})),
    vp AS (SELECT t.{key}, k.domain, sum(weight) * 0.5::DOUBLE AS pts FROM toks t JOIN vkw k ON t.value = k.kw GROUP BY t.{key}, k.domain),
    np AS (SELECT {key}, domain, sum(pts) AS pts, string_agg(col, ',' ORDER BY col) AS hits FROM pts GROUP BY {key}, domain),
    sc AS (SELECT s.{key}, d.domain, d.pos, coalesce(np.pts, 0) + coalesce(vp.pts, 0) AS score, coalesce(np.hits, '') AS hits
           FROM (SELECT DISTINCT {key} FROM cat) s CROSS JOIN doms d LEFT JOIN np ON np.{key} = s.{key} AND np.domain = d.domain
           LEFT JOIN vp ON vp.{key} = s.{key} AND vp.domain = d.domain),
    cf AS (SELECT *, sum(score) OVER (PARTITION BY {key}) AS tot FROM sc),
    cg AS (SELECT *, CASE WHEN tot > 0 THEN score / tot ELSE 0 END AS confidence FROM cf),
    ds AS (SELECT {key}, domain, score, confidence, hits,
             row_number() OVER (PARTITION BY {key} ORDER BY confidence DESC, CASE WHEN tot = 0 AND domain = 'General' THEN -1 ELSE pos END)::INTEGER AS rank FROM cg)"""


def mismatch(detected: str, chosen: str, confidence: str) -> str:
    related = " OR ".join(
        f"({detected} = {quote(d)} AND {chosen} IN ({', '.join(map(quote, o))}))" for d, o in K.RELATED_DOMAINS.items()
    )
    return f"({confidence} >= 0.2 AND NOT ({detected} = {chosen} OR {detected} = 'General' OR {related}))"


def severity(gap: str) -> str:
    return f"CASE WHEN {gap} > 0.4 THEN 'HIGH' WHEN {gap} > 0.2 THEN 'MEDIUM' ELSE 'LOW' END"


def counts() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, count(*) AS row_count, {len(COLUMNS[t].split())}::BIGINT AS column_count FROM {t}"
        for t in TABLES
    )


def bootstrap_sql() -> str:
    upto, term, whens = 0.0, math.exp(-1), []
    for k in range(12):
        upto += term
        whens.append(f"WHEN u < {math.ceil(upto * 2**32)} THEN {k}")
        term /= k + 1
    mixed = "(xor({0} >> 16, {0}) * 73244475) & 4294967295"
    return f"""WITH h AS (SELECT event_type, value AS x, ('0x' || substr(md5, 1, 8))::BIGINT AS h, ('0x' || substr(md5, 9, 8))::BIGINT AS step
               FROM (SELECT *, {key_md5('event_id')} AS md5 FROM events)),
      u0 AS (SELECT event_type, x, rep, (h + rep * step) & 4294967295 AS u FROM h CROSS JOIN (SELECT unnest(range(0, 100)) AS rep) r),
      u1 AS (SELECT event_type, x, rep, {mixed.format("u")} AS u FROM u0),
      u AS (SELECT event_type, x, rep, {mixed.format("u")} AS u FROM u1),
      w AS (SELECT event_type, rep, x, CASE {" ".join(whens)} ELSE 12 END AS w FROM u),
      m AS (SELECT event_type, rep, sum(w * x) / sum(w) AS m FROM w GROUP BY event_type, rep),
      s AS (SELECT event_type, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, stddev_samp(m) AS se FROM m GROUP BY event_type),
      p AS (SELECT event_type, count(value) AS n, avg(value) AS mean FROM events GROUP BY event_type)
      SELECT p.event_type, n, {rnd("mean", name="point_estimate")}, {rnd("lo", name="lower_bound")}, {rnd("hi", name="upper_bound")},
        {rnd("se", name="standard_error")} FROM p JOIN s ON p.event_type = s.event_type"""


def correlation_sql() -> str:
    columns = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    pairs = " UNION ALL ".join(
        f"SELECT l_returnflag, '{a}' AS col_a, '{b}' AS col_b, "
        + ("1.0::DOUBLE AS r" if a == b else f"round(corr({a}, {b}), 6) AS r")
        + f" FROM {LINEITEM} GROUP BY l_returnflag"
        for a in columns
        for b in columns
    )
    return pairs


def correlation_wide_sql() -> str:
    columns = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", *[f"w{i}" for i in range(len(WIDE))]]
    made = ", ".join(f"{e} AS w{i}" for i, e in enumerate(WIDE))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = ", ".join("1.0::DOUBLE" if a == b else f"coalesce(round(corr({a}, {b}), 6), 0)" for a, b in pairs)
    return f"""WITH src AS MATERIALIZED (SELECT *, {made} FROM {LINEITEM}),
      agg AS (SELECT l_returnflag, [{wide}] AS rs FROM src GROUP BY l_returnflag),
      tall AS (SELECT l_returnflag, unnest({strings(a for a, _ in pairs)}) AS a, unnest({strings(b for _, b in pairs)}) AS b, unnest(rs) AS r FROM agg)
      SELECT l_returnflag, a AS col_a, b AS col_b, r FROM tall UNION ALL SELECT l_returnflag, b, a, r FROM tall WHERE a <> b"""


def describe_sql() -> str:
    out = []
    for c in COLUMNS["part"].split():
        if c in ("p_name", "p_brand", "p_type"):
            out.append(
                f"SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS \"unique\", "
                f"(SELECT {c} FROM part GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top, "
                f"(SELECT max(k) FROM (SELECT count(*) AS k FROM part GROUP BY {c})) AS freq, "
                + ", ".join(f"NULL::DOUBLE AS {m}" for m in ("mean", "std", "min", "q25", "q50", "q75", "max"))
                + " FROM part"
            )
        else:
            v = f"{c}::DOUBLE"
            out.append(
                f"SELECT '{c}' AS \"column\", count({c}) AS n, NULL::BIGINT AS \"unique\", NULL::VARCHAR AS top, NULL::BIGINT AS freq, "
                f"round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std, round(min({v}), 4) AS min, "
                + ", ".join(f"round(quantile_cont({v}, {q}), 4) AS {n}" for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))
                + f", round(max({v}), 4) AS max FROM part"
            )
    return " UNION ALL ".join(out)


def null_rows(extra: str) -> str:
    return " UNION ALL ".join(
        f"SELECT l_linestatus, '{c}' AS \"column\", {extra.replace('COL', c)} FROM {LINEITEM} GROUP BY l_linestatus"
        for c in LINEITEM_COLUMNS
    )


def groups_sql(overall: bool) -> str:
    """Column groups of orders joined with customer."""
    source = """(SELECT o.*, c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal >= 2500 THEN c_acctbal END AS c_acctbal, c_mktsegment
      FROM orders o JOIN customer c ON o_custkey = c_custkey)"""
    groups = {
        "Finance": ["o_totalprice"],
        "Social Media": [],
        "Computer Vision": ["c_mktsegment"],
        "Music/Audio": ["o_orderkey", "o_custkey", "c_custkey", "c_nationkey"],
        "E-Commerce": ["o_orderstatus", "o_orderdate", "o_orderpriority"],
        "General": ["c_name", "c_acctbal"],
    }
    numbers = {"o_orderkey", "o_custkey", "o_totalprice", "c_custkey", "c_nationkey", "c_acctbal"}
    parts, names = [], []
    for i, (domain, members) in enumerate((d, m) for d, m in groups.items() if m):
        tagged = f"(SELECT {quote(domain)} AS domain, {', '.join(members)} FROM {source})"
        numeric = [c for c in members if c in numbers]
        other = [c for c in members if c not in numbers]
        fill = " + ".join(f"count({c})" for c in members)
        high = "list_filter([" + ", ".join(
            f"CASE WHEN (count(*) - count({c})) / count(*) > 0.2 THEN '{c}' END" for c in members
        ) + "], lambda c: c IS NOT NULL)"
        if not numeric:
            body = f"vals0 AS (SELECT 1), {table_quality_cte(tagged, 'domain', [f'NULL'], other, members, str(len(members)))}"
        else:
            body = table_quality_cte(tagged, "domain", numeric, other, members, str(len(members)))
        names.append(f"g{i}")
        wanted = K.GROUP_ROWS[domain]
        parts.append(
            f"""g{i} AS (WITH {body}, extra AS (SELECT ({fill}) / (count(*) * {len(members)}) AS data_coverage,
                array_to_string({high}, ',') AS high_null_columns FROM {tagged})
              SELECT tq.*, data_coverage, high_null_columns, {wanted}::BIGINT AS recommended_rows, row_count / {wanted} AS sufficiency_ratio FROM tq, extra)"""
        )
    union = " UNION ALL BY NAME ".join(f"SELECT * FROM {n}" for n in names)
    base = f"""WITH {", ".join(parts)}, allg AS ({union}),
      r1 AS (SELECT *, column_count / 11 AS column_share, CASE WHEN sufficiency_ratio >= 2 THEN 'ABUNDANT' WHEN sufficiency_ratio >= 1 THEN 'SUFFICIENT'
               WHEN sufficiency_ratio >= 0.5 THEN 'MARGINAL' WHEN sufficiency_ratio >= 0.1 THEN 'INSUFFICIENT' ELSE 'CRITICALLY_INSUFFICIENT' END AS sufficiency,
               0.6::DOUBLE * total_score / 100 + 0.4::DOUBLE * least(sufficiency_ratio, 2) / 2 AS rank_score FROM allg),
      r2 AS (SELECT *, row_number() OVER (ORDER BY rank_score DESC, domain)::INTEGER AS rank FROM r1)"""
    if overall:
        return base + f""" SELECT max(row_count) AS row_count, count(*) AS n_groups, round(sum(total_score * column_share), 6) AS weighted_quality,
          max(domain) FILTER (WHERE rank = 1) AS dominant_domain, round(max(column_share) FILTER (WHERE rank = 1), 6) AS dominant_column_share,
          round(sum(avg_missing_pct * column_count) / 11, 6) AS global_null_pct FROM r2"""
    return base + """ SELECT domain, row_count, column_count, round(column_share, 6) AS column_share, round(avg_missing_pct, 6) AS avg_missing_pct,
      round(data_coverage, 6) AS data_coverage, duplicate_count, round(duplicate_pct, 6) AS duplicate_pct, round(completeness, 6) AS completeness,
      round(duplication, 6) AS duplication, round(noise, 6) AS noise, round(balance, 6) AS balance, round(structural_integrity, 6) AS structural_integrity,
      round(total_score, 6) AS total_score, grade, recommended_rows, round(sufficiency_ratio, 6) AS sufficiency_ratio, sufficiency,
      round(rank_score, 6) AS rank_score, rank, high_null_columns,
      ((sufficiency IN ('INSUFFICIENT', 'CRITICALLY_INSUFFICIENT'))::INT + (total_score < 55)::INT + (high_null_columns <> '')::INT)::BIGINT AS n_advice FROM r2"""


def recommendation_sql() -> str:
    lines = [
        ("duplicate_pct > 10 OR duplicate_pct > 15", "Remove repeated lines"),
        ("type_token_ratio < 0.15", "Add sources with a richer vocabulary"),
        ("max_line_length > avg_line_length * 12 OR outlier_pct > 1", "Drop lines whose length is beyond three deviations of the mean"),
        ("sampled_lines < 1000", "Collect far more lines"),
        ("low_entropy_pct > 5", "Drop padding and lines that repeat few characters"),
        ("memorization_level IN ('CRITICAL', 'HIGH')", "Collect far more data before training"),
        ("memorization_level IN ('CRITICAL', 'HIGH')", "Train with differential privacy"),
        ("memorization_level IN ('CRITICAL', 'HIGH') OR duplicate_pct > 5", "Remove repeated samples"),
        ("memorization_level = 'MEDIUM'", "Clip gradients and stop early"),
        ("memorization_level = 'MEDIUM'", "Consider a smaller model"),
        ("type_token_ratio < 0.15", "Add sources, styles and perspectives"),
        ("fingerprint_matches > 0", "Verify that no test split is included"),
        ("fingerprint_matches > 0", "Decontaminate against the suspected test sets"),
        ("phrase_hits > 0", "Decontaminate before evaluating on benchmarks"),
        ("type_fit = 0", "Choose an AI type that takes this kind of data"),
        ("architecture_fit < 100", "Choose an architecture that suits the task"),
        ("size_fit < 50", "Collect more data or choose a smaller model"),
        ("quality_fit < 100", "Raise the quality to what the domain asks for"),
        ("chinchilla_ratio < 0.5 AND token_count > 0", "Collect the tokens the model size asks for"),
        ("chinchilla_ratio < 0.5 AND token_count > 0", "Consider a smaller model size"),
        ("total_pflops > 100", "Use mixed precision and gradient checkpointing"),
    ]
    union = " UNION ".join(f"SELECT source, {quote(t)} AS recommendation FROM res WHERE {c}" for c, t in lines)
    return f"WITH {score_text_cte('documents', 'source')}, {scenario_values(SIZES)}, {scenario_cte('text')} {union}"


def events_audit_sql() -> str:
    scenarios = [
        {"ai_type": "Recommendation", "model_size": "Small", "domain": "Social Media", "param_count_millions": 2.0},
        {"ai_type": "NLP", "model_size": "Medium", "domain": "Healthcare", "param_count_millions": 125.0},
    ]
    cat = " UNION ALL ".join(
        f"SELECT DISTINCT event_type, '{c}' AS col FROM events" for c in COLUMNS["events"].split()
    )
    points = f"SELECT event_type, {key_md5('event_id')} AS k, event_id AS k2, [event_id::DOUBLE, user_id::DOUBLE, value] AS vec FROM {EVENTS}"
    gap = "(domain_confidence - coalesce((SELECT confidence FROM ds d WHERE d.event_type = card.event_type AND d.domain = scen.domain), 0))"
    differs = mismatch("detected_domain", "scen.domain", "domain_confidence")
    severity_sql = f"CASE WHEN NOT {differs} THEN 'NONE' ELSE {severity(gap)} END"
    findings = [
        *TABLE_FINDINGS,
        *SHARED_FINDINGS,
        ("BENCHMARK_PRINT", "warning", "contamination_score > 0", "row_count"),
    ]
    return f"""WITH {event_quality()}, {geometry_cte(points, "event_type")},
      cat AS ({cat}), {domain_cte("event_type", "SELECT event_type, label AS value FROM labs")},
      drift AS (SELECT event_type, max(CASE WHEN max_prop > 0.7 THEN 1 - gini WHEN max_prop > 0.5 THEN (1 - gini) / 2 END) AS peak,
                  count(*) FILTER (WHERE max_prop > 0.5) AS signals, count(*) FILTER (WHERE max_prop > 0.5) + count(*) FILTER (WHERE n_classes < 3) AS drift_warnings
                FROM bm GROUP BY event_type),
      bal AS (SELECT event_type, count(*) FILTER (WHERE max_prop > 0.8) AS severe, count(*) FILTER (WHERE max_prop > 0.65 AND max_prop <= 0.8) AS moderate FROM bm GROUP BY event_type),
      card AS (SELECT tq.*, outlier_pct, isolated_pct, vulnerability_score, vulnerability_level,
                 CASE WHEN signals = 0 THEN 10.0::DOUBLE ELSE {clamp("(peak + least(0.2::DOUBLE, 0.05::DOUBLE * signals)) * 100")} END AS drift_score,
                 drift_warnings, severe, moderate, row_count * column_count AS token_count, row_count AS ci_n,
                 CASE WHEN row_count BETWEEN 800 AND 1100 AND column_count IN (2, 3) THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END AS contamination_score,
                 ds.domain AS detected_domain, ds.confidence AS domain_confidence
               FROM tq JOIN geo ON tq.event_type = geo.event_type JOIN drift ON tq.event_type = drift.event_type
               JOIN bal ON tq.event_type = bal.event_type JOIN ds ON tq.event_type = ds.event_type AND ds.rank = 1),
      {scenario_values(scenarios)}, {scenario_cte("tabular", severity_sql)},
      res2 AS (SELECT *, {tier("drift_score", K.FAIRNESS_TIERS)} AS drift_level, {tier("contamination_score", K.CONTAMINATION_TIERS)} AS contamination_level FROM res),
      {card_select(["event_type", "detected_domain", "domain_confidence", "mismatch_severity"], findings).replace("FROM res)", "FROM res2)").replace("AS critical_issues", "+ severe AS critical_issues", 1).replace("AS warnings", "+ moderate + drift_warnings AS warnings", 1)}"""


def docs_audit(select: str) -> str:
    return f"WITH {score_text_cte('documents', 'source')}, {scenario_values(SIZES)}, {scenario_cte('text')} {select}"


def build() -> dict[str, str]:
    corpora = lines_cte(CORPORA, "corpus")
    matched = ", ".join(
        f"CASE WHEN line_count BETWEEN {a} AND {b} AND avg_raw_length BETWEEN {c} AND {d} THEN '{n}' END"
        for n, a, b, c, d in K.BENCHMARK_PRINTS
        if a > 0
    )
    text_columns = (
        "line_count, char_count, sampled_lines, unique_lines, round(avg_line_length, 6) AS avg_line_length, max_line_length, min_line_length, "
        "round(avg_word_count, 6) AS avg_word_count, round(std_length, 6) AS std_length, outlier_lines, low_entropy_lines, phrase_hits, word_count, vocab_size, "
        "round(type_token_ratio, 6) AS type_token_ratio, duplicate_lines, round(duplicate_pct, 6) AS duplicate_pct, round(outlier_pct, 6) AS outlier_pct, "
        "round(low_entropy_pct, 6) AS low_entropy_pct, round(avg_raw_length, 6) AS avg_raw_length, estimated_tokens"
    )
    flags = unpivot(LINEITEM, ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag")
    gap_events = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) / count(*)" for c in ("user_id", "event_type", "value", "props"))
    q: dict[str, str] = {}
    q["table_summary_lineitem"] = "SELECT l_returnflag, count(*) AS row_count, 11::BIGINT AS column_count FROM lineitem GROUP BY l_returnflag"
    q["preview_customer"] = "SELECT " + ", ".join(f"coalesce({c}::VARCHAR, '') AS {c}" for c in COLUMNS["customer"].split()) + " FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)"
    q["missing_lineitem"] = null_rows("count(*) AS row_count, count(*) - count(COL) AS nulls, round((count(*) - count(COL)) / count(*) * 100.0::DOUBLE, 6) AS missing_pct, count(COL) = 0 AS all_null, count(COL) = count(*) AS complete")
    q["complete_columns_lineitem"] = f"SELECT l_linestatus, \"column\" FROM ({null_rows('count(COL) = count(*) AS ok')}) WHERE ok"
    q["coverage_lineitem"] = f"SELECT l_linestatus, round(sum(n) / sum(r), 6) AS data_coverage, round(avg((r - n) / r * 100.0::DOUBLE), 6) AS global_null_pct FROM ({null_rows('count(COL) AS n, count(*) AS r')}) GROUP BY l_linestatus"
    q["null_map_lineitem"] = null_rows("count(*) - count(COL) AS null_count, round((count(*) - count(COL)) / count(*) * 100.0::DOUBLE, 6) AS null_pct, count(DISTINCT COL) AS \"unique\", round(count(COL) / count(*), 6) AS fill_rate")
    q["duplicates_lineitem"] = """SELECT l_returnflag, sum(n)::BIGINT AS row_count, count(*) AS distinct_rows, (sum(n) - count(*))::BIGINT AS duplicate_count,
      round((sum(n) - count(*)) / sum(n) * 100.0::DOUBLE, 6) AS duplicate_pct FROM (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag"""
    q["numeric_stats_lineitem"] = f"""SELECT l_returnflag, "column", count(value) AS n, count(*) - count(value) AS nulls, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
      round(min(value), 4) AS min, round(max(value), 4) AS max, round(skewness(value), 4) AS skewness, round(median(value), 4) AS median FROM ({flags}) GROUP BY l_returnflag, "column" """
    q["quantiles_lineitem"] = " UNION ALL ".join(
        f'SELECT l_returnflag, "column", {p}::DOUBLE AS prob, round(quantile_cont(value, {p}), 4) AS value FROM ({flags}) GROUP BY l_returnflag, "column"' for p in (0.05, 0.5, 0.95)
    )
    q["histogram_orders"] = f"""WITH {histogram_cte(unpivot("orders", ["o_totalprice"], "o_orderstatus"), "o_orderstatus")}
      SELECT o_orderstatus, "column", bin, round(bin_lo, 4) AS bin_lo, round(bin_hi, 4) AS bin_hi, n FROM hist"""
    q["correlation_lineitem"] = correlation_sql()
    q["correlation_wide_lineitem"] = correlation_wide_sql()
    year = unpivot(ORDERS, ["o_orderstatus", "o_orderpriority"], "year", "VARCHAR")
    cb_columns = '"column", label, n, round(proportion, 6) AS proportion, rank'
    bm_columns = '"column", n_classes, ' + ", ".join(rnd(c) for c in ("max_prop", "min_prop", "gini", "entropy", "entropy_ratio"))
    q["class_balance_orders"] = f"WITH {balance_cte(year, 'year')} SELECT year, {cb_columns} FROM cb"
    q["balance_metrics_orders"] = f"WITH {balance_cte(year, 'year')} SELECT year, {bm_columns} FROM bm"
    q["balance_metrics_parts"] = f"WITH {balance_cte(unpivot('part', ['p_name', 'p_brand', 'p_type'], '', 'VARCHAR'), '')} SELECT {bm_columns} FROM bm"
    q["class_balance_part_names"] = f"WITH {balance_cte(unpivot('part', ['p_name', 'p_brand', 'p_type'], '', 'VARCHAR'), '')} SELECT {cb_columns} FROM cb"
    labelled = "(SELECT lang, quality, toxic FROM documents JOIN labels ON documents.doc_id = labels.doc_id)"
    q["class_balance_labels"] = f"WITH {balance_cte(unpivot(labelled, ['quality', 'toxic'], 'lang', 'VARCHAR'), 'lang')} SELECT lang, {cb_columns} FROM cb"
    q["describe_part"] = describe_sql()
    q["custom_stats_events"] = """SELECT event_type, count(*) AS row_count, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value,
      (arg_max(event_id, (value, event_id))) AS top_event FROM events GROUP BY event_type"""
    q["light_profile_events"] = f"""SELECT (SELECT count(*) FROM events) AS row_count, 4::BIGINT AS column_count,
      (SELECT round(list_avg([{gap_events}]) * 100, 6) FROM events) AS avg_missing_pct, sum(n - 1)::BIGINT AS duplicate_count, round(sum(n - 1) / sum(n) * 100.0::DOUBLE, 6) AS duplicate_pct
      FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type, value, props)"""
    q["light_states_events"] = " UNION ALL ".join(
        f"""SELECT event_type, {column} AS "column", count(*) AS row_count, {nulls}::BIGINT AS nulls, round({nulls} / count(*) * 100.0::DOUBLE, 6) AS missing_pct FROM {EVENTS} GROUP BY event_type"""
        for column, nulls in (("NULL", "0"), *((quote(c), f"(count(*) - count({c}))") for c in ("user_id", "value", "props")))
    )
    q["empty_slices_events"] = """SELECT ts::DATE AS day, event_type, count(*) FILTER (WHERE value > 200) AS row_count,
      (count(*) FILTER (WHERE value > 200) = 0)::BIGINT AS findings FROM events GROUP BY ALL"""
    strings_of = unpivot("(SELECT c_custkey, c_name, c_mktsegment FROM customer)", ["c_custkey", "c_name", "c_mktsegment"], "", "VARCHAR")
    q["csv_strings_roundtrip"] = f"WITH {balance_cte(strings_of, '')} SELECT {bm_columns} FROM bm"
    q["hash_sample_events"] = f"SELECT event_id, event_type FROM events WHERE ('0x' || substr({key_md5('event_id')}, 1, 8))::UBIGINT / 4294967296.0::DOUBLE < 0.1::DOUBLE"
    q["top_hash_events"] = f"""SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {key_md5('event_id')}, event_id)::INTEGER AS rank FROM events) WHERE rank <= 100"""
    n = "row_count"
    q["auto_sample_sizes"] = f"""SELECT dataset, {n}, (CASE WHEN {n} = 0 THEN 1000 WHEN {n} <= 1000 THEN {n} ELSE greatest(1000, least(1000000, {n},
        floor({n} * CASE WHEN {n} < 10000 THEN 1.0::DOUBLE WHEN {n} < 100000 THEN 0.5::DOUBLE WHEN {n} < 1000000 THEN 0.2::DOUBLE WHEN {n} < 10000000 THEN 0.05::DOUBLE ELSE 0.01::DOUBLE END))) END)::BIGINT AS sample_size,
      (CASE WHEN {n} <= 1000 THEN {n} ELSE greatest(1000, least(5000, {n})) END)::BIGINT AS requested_size FROM ({counts()})"""
    q["text_summary_docs"] = f"""WITH {lines_cte('documents', 'lang')} SELECT raw.lang, count(*) AS line_count, any_value(char_count) AS char_count, round(any_value(char_count) / count(*), 6) AS avg_raw_length,
      floor(any_value(char_count) / 4)::BIGINT AS estimated_tokens FROM raw JOIN chars ON raw.lang = chars.lang GROUP BY raw.lang"""
    q["head_lines_docs"] = """WITH p AS (SELECT lang, doc_id, string_split(text, chr(10)) AS p FROM documents),
      l AS (SELECT lang, doc_id, unnest(p) AS line, (generate_subscripts(p, 1) - 1)::INTEGER AS line_no, len(p) AS n FROM p),
      r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) AS rk FROM l WHERE line <> '' OR line_no < n - 1)
      SELECT lang, doc_id, line_no, line FROM r WHERE rk <= 5"""
    q["line_profile_docs"] = f"WITH {text_cte('documents', 'lang')} SELECT lang, {text_columns} FROM prof"
    q["line_stats_conversations"] = f"""WITH {lines_cte('conversations', 'role')} SELECT role, count(*) AS sampled_lines, round(avg(len), 6) AS avg_line_length, max(len) AS max_line_length,
      min(len) AS min_line_length, round(avg(words), 6) AS avg_word_count FROM lines GROUP BY role"""
    q["duplicate_lines_corpora"] = f"""WITH {corpora} SELECT corpus, count(*) AS sampled_lines, count(DISTINCT line) AS unique_lines, count(*) - count(DISTINCT line) AS duplicate_lines,
      round((count(*) - count(DISTINCT line)) / count(*) * 100.0::DOUBLE, 6) AS duplicate_pct FROM lines GROUP BY corpus"""
    q["vocab_conversations"] = f"""WITH {lines_cte('conversations', 'role')} SELECT role, count(*) AS word_count, count(DISTINCT w) AS vocab_size, round(count(DISTINCT w) / count(*), 6) AS type_token_ratio
      FROM (SELECT role, unnest(list_filter(regexp_split_to_array(lower(line), '\\s+'), lambda w: w <> '')) AS w FROM lines) GROUP BY role"""
    q["length_histogram_docs"] = f"""WITH {lines_cte('documents', 'lang')}, {histogram_cte('SELECT lang, ' + quote('length') + ' AS "column", len::DOUBLE AS value FROM lines', 'lang')}
      SELECT lang, bin, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi, n FROM hist"""
    q["length_outliers_docs"] = f"""WITH {text_cte('documents', 'source')} SELECT source, sampled_lines, round(avg_line_length, 6) AS mean_length, round(std_length, 6) AS std_length, outlier_lines,
      round(outlier_pct, 6) AS outlier_pct FROM prof"""
    q["low_entropy_corpora"] = f"""WITH {corpora} SELECT corpus, count(*) AS sampled_lines, count(*) FILTER (WHERE {ENTROPY} < 2.0) AS low_entropy_lines,
      round(count(*) FILTER (WHERE {ENTROPY} < 2.0) / count(*) * 100.0::DOUBLE, 6) AS low_entropy_pct FROM lines GROUP BY corpus"""
    q["text_vulnerability_docs"] = f"""WITH {score_text_cte('documents', 'lang')} SELECT lang, sampled_lines, round(avg_line_length, 6) AS mean_length, round(std_length, 6) AS std_length, outlier_lines,
      round(outlier_pct, 6) AS outlier_pct, low_entropy_lines, round(low_entropy_pct, 6) AS low_entropy_pct, round(vulnerability_score, 6) AS vulnerability_score, vulnerability_level FROM card"""
    q["quality_events"] = f"WITH {event_quality()} SELECT event_type, {TQ_COLUMNS} FROM tq"
    q["noise_events"] = f'WITH {event_quality()} SELECT event_type, "column", ' + ", ".join(rnd(c) for c in ("mean", "std", "outlier_frac", "cv", "noise")) + " FROM nn"
    q["quality_docs"] = f"WITH {score_text_cte('documents', 'lang')} SELECT lang, " + ", ".join(
        rnd(c) for c in ("completeness", "duplication", "vocabulary_diversity", "noise", "structural_integrity", "total_score")
    ) + f", {grade('total_score')} AS grade FROM card"
    q["geometry_embeddings"] = f"""WITH {geometry_cte(f"SELECT 1 AS one, {key_md5('vec_id')} AS k, vec_id AS k2, embedding::DOUBLE[] AS vec FROM embeddings", "one")} SELECT {GEO_COLUMNS} FROM geo"""
    key = key_md5("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    q["geometry_lineitem"] = f"""WITH {geometry_cte(f"SELECT l_returnflag, {key} AS k, (l_orderkey, l_partkey) AS k2, [l_linenumber::DOUBLE, l_quantity, l_extendedprice, l_discount, l_tax] AS vec FROM {LINEITEM}", "l_returnflag")}
      SELECT l_returnflag, {GEO_COLUMNS} FROM geo"""
    q["fingerprint_corpora"] = f"""WITH {corpora}, s AS (SELECT raw.corpus, count(*) AS line_count, any_value(char_count) / count(*) AS avg_raw_length FROM raw JOIN chars ON raw.corpus = chars.corpus GROUP BY raw.corpus),
      m AS (SELECT *, list_filter([{matched}], lambda x: x IS NOT NULL) AS hits FROM s)
      SELECT corpus, line_count, round(avg_raw_length, 6) AS avg_raw_length, array_to_string(hits, ',') AS suspicious, len(hits) AS fingerprint_matches FROM m"""
    q["phrase_hits_docs"] = f"WITH {lines_cte('documents', 'source')} SELECT source, count(*) AS line_count, count(*) FILTER (WHERE {HIT}) AS phrase_hits FROM raw GROUP BY source"
    q["text_contamination_corpora"] = f"WITH {score_text_cte(CORPORA, 'corpus')} SELECT corpus, phrase_hits, round(contamination_score, 6) AS contamination_score, contamination_level FROM card"
    fp = "row_count BETWEEN 800 AND 1100 AND column_count IN (2, 3)"
    q["ngram_overlap_docs"] = f"""WITH {overlap_cte()} SELECT doc_id, item_id, n, count(*) AS shared_shingles, item_shingles, round(count(*) / item_shingles * 100.0::DOUBLE, 6) AS item_coverage
      FROM ds JOIN bs USING (n, s) JOIN size USING (item_id, n) GROUP BY doc_id, item_id, n, item_shingles"""
    q["ngram_contamination_docs"] = f"""WITH {overlap_cte()},
      hit AS (SELECT source, n, count(DISTINCT r) AS hit_docs FROM ds WHERE (n, s) IN (SELECT (n, s) FROM bs) GROUP BY source, n),
      item AS (SELECT source, n, item_id, count(*) AS f, any_value(item_shingles) AS k FROM (SELECT DISTINCT source, n, s FROM ds) JOIN bs USING (n, s) JOIN size USING (item_id, n) GROUP BY source, n, item_id),
      items AS (SELECT source, n, count(*) AS items_hit, max(f / k * 100.0::DOUBLE) AS max_item_coverage, count(*) FILTER (WHERE f = k) AS whole_items FROM item GROUP BY source, n),
      j AS (SELECT source, n, doc_count, coalesce(hit_docs, 0) AS hit_docs, coalesce(items_hit, 0) AS items_hit, coalesce(max_item_coverage, 0) AS max_item_coverage, coalesce(whole_items, 0) AS whole_items
            FROM (SELECT source, count(*) AS doc_count FROM documents GROUP BY source) CROSS JOIN (VALUES (5), (8), (13)) AS sizes(n) LEFT JOIN hit USING (source, n) LEFT JOIN items USING (source, n)),
      sc AS (SELECT *, least(100.0::DOUBLE, items_hit * 10.0::DOUBLE) AS contamination_score FROM j)
      SELECT *, round(hit_docs / doc_count * 100.0::DOUBLE, 6) AS hit_pct, {tier("contamination_score", K.CONTAMINATION_TIERS)} AS contamination_level
      FROM (SELECT * REPLACE (round(max_item_coverage, 6) AS max_item_coverage) FROM sc)"""
    q["table_fingerprint"] = f"SELECT dataset, row_count, column_count, CASE WHEN {fp} THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END AS contamination_score, CASE WHEN {fp} THEN 'MEDIUM' ELSE 'LOW' END AS contamination_level FROM ({counts()})"
    q["memorization_docs"] = docs_audit("SELECT source, model_size, token_count, " + ", ".join(rnd(c) for c in ("token_to_param_ratio", "effective_ratio")) + ", memorization_level, " + rnd("memorization_probability") + ", " + rnd("leakage_score") + ", privacy_flag FROM res")
    gpus = ", ".join(f"('{g}', {t}::DOUBLE, {p}::DOUBLE)" for g, t, p in K.GPUS)
    q["training_cost_docs"] = f"""WITH {score_text_cte('documents', 'lang')}, {scenario_values(SIZES)}, {scenario_cte('text')}, gpus(gpu, tflops, price) AS (VALUES {gpus}),
      h AS (SELECT res.*, gpu, price, total_flops / (tflops * 1e12::DOUBLE * 0.4::DOUBLE * 3600) AS hours FROM res CROSS JOIN gpus)
      SELECT lang, model_size, gpu, token_count, model_params_millions, round(chinchilla_ratio, 6) AS chinchilla_ratio, round(total_pflops, 6) AS total_pflops, data_sufficiency, round(hours, 6) AS hours, round(hours * price, 6) AS cost_usd FROM h"""
    skew = unpivot(SKEWED, ["o_orderstatus", "o_orderpriority", "urgency", "delay"], "year", "VARCHAR")
    drift = clamp("(peak + least(0.2::DOUBLE, 0.05::DOUBLE * signals)) * 100")
    q["fairness_orders"] = f"""WITH {balance_cte(skew, 'year')}, f AS (SELECT year, max(CASE WHEN max_prop > 0.7 THEN 1 - gini WHEN max_prop > 0.5 THEN (1 - gini) / 2 END) AS peak,
        count(*) FILTER (WHERE max_prop > 0.5) AS signals, count(*) FILTER (WHERE max_prop > 0.6) AS skewed_columns, count(*) AS categorical_columns FROM bm GROUP BY year),
      g AS (SELECT *, CASE WHEN signals = 0 THEN 10.0::DOUBLE ELSE {drift} END AS drift_score FROM f)
      SELECT year, skewed_columns, categorical_columns, round(drift_score, 6) AS drift_score, {tier('drift_score', K.FAIRNESS_TIERS)} AS drift_level, round(skewed_columns / categorical_columns * 100.0::DOUBLE, 6) AS shift_vulnerability FROM g"""
    q["fairness_docs"] = f"WITH {score_text_cte('documents', 'source')} SELECT source, round(type_token_ratio, 6) AS type_token_ratio, round(drift_score, 6) AS drift_score, drift_level FROM card"
    catalog = f"WITH {catalog_cte()}, {domain_cte('dataset', all_values())}"
    q["domain_scores_catalog"] = f"{catalog} SELECT dataset, domain, round(score, 6) AS score, round(confidence, 6) AS confidence, rank, hits FROM ds"
    q["detect_domain_catalog"] = f"""{catalog} SELECT dataset, max(domain) FILTER (WHERE rank = 1) AS detected_domain, round(max(confidence), 6) AS confidence,
      max(domain) FILTER (WHERE rank = 2 AND confidence > 0.25) AS runner_up, max(confidence) < 0.35 AS low_confidence FROM ds GROUP BY dataset"""
    q["domain_mismatch_catalog"] = f"""{catalog}, one AS (SELECT dataset, domain AS detected_domain, confidence FROM ds WHERE rank = 1),
      m AS (SELECT one.*, ds.domain AS selected_domain, {mismatch('detected_domain', 'ds.domain', 'one.confidence')} AS mismatch, one.confidence - ds.confidence AS gap FROM one JOIN ds ON one.dataset = ds.dataset)
      SELECT dataset, selected_domain, detected_domain, round(confidence, 6) AS confidence, mismatch, CASE WHEN NOT mismatch THEN 'NONE' ELSE {severity('gap')} END AS mismatch_severity,
        CASE WHEN mismatch THEN round(gap, 6) END AS score_gap FROM m"""
    q["assign_columns_catalog"] = f"""WITH {catalog_cte()}, {signature_cte()},
      t AS (SELECT dataset, col, list_distinct(regexp_split_to_array(lower(col), '[_\\-\\s\\.]+')) AS toks FROM cat),
      s AS (SELECT dataset, col, domain, pos, any_value(weight) * (2 * count(*) FILTER (WHERE list_contains(toks, kw)) + 0.8::DOUBLE * count(*) FILTER (WHERE contains(lower(col), kw))) AS pts
            FROM t CROSS JOIN nkw GROUP BY dataset, col, domain, pos),
      r AS (SELECT *, row_number() OVER (PARTITION BY dataset, col ORDER BY pts DESC, pos) AS rk FROM s)
      SELECT dataset, col AS "column", CASE WHEN pts > 0 THEN domain ELSE 'General' END AS domain, round(pts, 6) AS points FROM r WHERE rk = 1"""
    q["column_groups_customer"] = groups_sql(False)
    q["multi_domain_customer"] = groups_sql(True)
    grid = f"WITH {score_text_cte('documents', 'lang')}, {scenario_values(GRID)}, {scenario_cte('text')}"
    q["compatibility_docs"] = f"""{grid} SELECT lang, ai_type, model_size, architecture, domain, task_type, type_fit, architecture_fit, data_size, required_size, round(size_fit, 6) AS size_fit,
      round(quality_fit, 6) AS quality_fit, round(compatibility_score, 6) AS compatibility_score, suitability, size_verdict, best_ai_type, best_model_size FROM res"""
    q["simulate_grid"] = f"""{grid} SELECT lang, ai_type, model_size, domain, round(compatibility_score, 6) AS compatibility_score, model_params_millions, round(chinchilla_ratio, 6) AS chinchilla_ratio,
      round(total_pflops, 6) AS total_pflops, data_sufficiency, round(effective_ratio, 6) AS effective_ratio, memorization_level, round(leakage_score, 6) AS leakage_score FROM res"""
    q["bootstrap_events"] = bootstrap_sql()
    margin = f"{K.Z_95}::DOUBLE * sqrt(100 / sampled_lines)"
    q["risk_ci_docs"] = f"WITH {score_text_cte('documents', 'source')} " + " UNION ALL ".join(
        f"SELECT source, '{r}' AS risk, round({c}, 6) AS value, round(greatest(0, {c} - {margin}), 6) AS lower_bound, round(least(100, {c} + {margin}), 6) AS upper_bound, round(sqrt(100 / sampled_lines), 6) AS standard_error FROM card"
        for r, c in (("adversarial", "vulnerability_score"), ("fairness", "drift_score"), ("contamination", "contamination_score"), ("quality", "total_score"))
    )
    findings = [*TEXT_FINDINGS, *SHARED_FINDINGS]
    q["issues_docs"] = docs_audit(
        " UNION ALL ".join(
            f"SELECT source, model_size, '{code}' AS code, '{sev}' AS severity, round(({v})::DOUBLE, 6) AS value FROM res WHERE {cond}" for code, sev, cond, v in findings
        )
    )
    q["recommendations_docs"] = recommendation_sql()
    q["audit_docs_by_source"] = f"WITH {score_text_cte('documents', 'source')}, {scenario_values(SIZES)}, {scenario_cte('text')}, " + card_select(["source"], findings).replace("ci_n", "sampled_lines")
    q["audit_events_by_type"] = events_audit_sql()
    q["csv_roundtrip"] = "SELECT o_orderstatus, o_orderpriority, count(*) AS row_count, round(sum(o_totalprice), 2) AS total_price, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL"
    q["lines_roundtrip"] = f"""WITH {lines_cte("(SELECT 1 AS one, text FROM documents)", "one")} SELECT count(*) AS sampled_lines, round(avg(len), 6) AS avg_line_length, max(len) AS max_line_length, min(len) AS min_line_length,
      round(avg(words), 6) AS avg_word_count FROM lines"""
    q["scorecard_roundtrip"] = f"WITH {score_text_cte('documents', 'lang')} SELECT lang, {grade('total_score')} AS grade, round(total_score, 6) AS total_score, contamination_level FROM card".replace(HIT, " OR ".join(f"contains(lower(line), {quote(p)})" for p in K.BENCHMARK_PHRASES))
    m = f"{K.Z_95}::DOUBLE * sqrt(100 / n_chars)"
    q["grades_docs"] = f"""WITH s AS (SELECT doc_id, n_chars, (n_chars % 1009) / 10.0::DOUBLE AS score FROM documents)
      SELECT doc_id, round(score, 6) AS score, {grade('score')} AS grade, {tier('score', K.VULNERABILITY_TIERS)} AS tier,
        round(CASE WHEN n_chars <= 1 THEN score ELSE greatest(0, score - {m}) END, 6) AS lower_bound, round(CASE WHEN n_chars <= 1 THEN score ELSE least(100, score + {m}) END, 6) AS upper_bound FROM s"""
    return q


ORACLES = build()
