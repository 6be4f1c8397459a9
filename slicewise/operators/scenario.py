"""What-if questions: one row per slice and scenario.

A scenario is a training configuration. Scenarios, GPUs and lookup tables are short lists known when the
plan is built; they enter it as literals, so no operator here joins or shuffles. Input rows need
``data_type`` (text or tabular), ``token_count`` and what the single operators name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.functions import constants as K
from slicewise.functions.exprs import clamp_sql, pick_sql, text_sql, tier_sql
from slicewise.functions.issues import Issue, advice_sql, issues_sql
from slicewise.operators.domain import with_mismatch

FLOPS_PER_TOKEN_AND_PARAM = 6.0
TOKENS_PER_PARAM = 20.0
SCENARIO_FIELDS = list(K.SCENARIO_DEFAULTS)
# Weights of the four fits and the cap for the wrong kind of data.
FIT_WEIGHTS = {"type_fit": 0.30, "architecture_fit": 0.30, "size_fit": 0.15, "quality_fit": 0.25}
WRONG_KIND_CAP = 35.0


def check_scenario(scenario: dict) -> dict:
    """Fill in defaults and reject unknown names."""
    unknown = set(scenario) - set(K.SCENARIO_DEFAULTS)
    if unknown:
        raise ValueError(f"Unknown scenario fields: {sorted(unknown)}")
    full = {**K.SCENARIO_DEFAULTS, **{k: v for k, v in scenario.items() if v is not None}}
    for field, valid in K.SCENARIO_CHOICES.items():
        if full[field] not in valid:
            raise ValueError(f"Invalid {field} {full[field]!r}. Valid: {sorted(valid)}")
    return full


def with_scenarios(slices: DataFrame, scenarios: Sequence[dict]) -> DataFrame:
    """Repeat every slice row once per scenario."""
    rows = []
    for scenario in scenarios:
        full = check_scenario(scenario)
        values = {
            f: f"{float(full[f])}D" if f == "param_count_millions" else text_sql(full[f])
            for f in SCENARIO_FIELDS
        }
        rows.append("named_struct(" + ", ".join(f"'{f}', {v}" for f, v in values.items()) + ")")
    return slices.selectExpr("*", f"inline(array({', '.join(rows)}))")


def token_counts(summary: DataFrame, data_type: str) -> DataFrame:
    """Token estimate of summaries: a quarter of the characters, or one token per cell."""
    if data_type == "text":
        tokens = F.floor(F.col("char_count") / 4)
    elif data_type == "tabular":
        tokens = F.col("row_count") * F.col("column_count")
    else:
        raise ValueError(f"Unsupported data type: {data_type}")
    return summary.withColumn("data_type", F.lit(data_type)).withColumn(
        "token_count", F.coalesce(tokens, F.lit(0)).cast("bigint")
    )


def memorization(slices: DataFrame, params_m: str = "param_count_millions") -> DataFrame:
    """Tokens per parameter, lowered by duplication, and the risk that a model learns samples by heart.

    Needs ``duplicate_pct``. ``params_m`` is a column or SQL expression of parameters in millions.
    """
    high = "memorization_level IN ('CRITICAL', 'HIGH')"
    medium = "memorization_level = 'MEDIUM'"
    few = "(data_type = 'text' AND token_count < 1000000)"
    copied = "duplicate_pct > 5"
    found = [
        Issue(high, "FEW_TOKENS_PER_PARAMETER", "warning", "effective_ratio", "effective tokens per parameter: memorization is likely"),
        Issue(medium, "MODERATE_TOKENS_PER_PARAMETER", "warning", "effective_ratio", "effective tokens per parameter: moderate risk"),
        Issue(few, "SMALL_CORPUS", "warning", "token_count", "tokens only: memorization is amplified"),
        Issue(copied, "DUPLICATION_AMPLIFIES", "warning", "duplicate_pct", "percent repeats amplify memorization"),
    ]
    told = advice_sql(
        (high, "Collect far more data before training"),
        (high, "Train with differential privacy"),
        (f"{high} OR {copied}", "Remove repeated samples"),
        (medium, "Clip gradients and stop early"),
        (medium, "Consider a smaller model"),
    )
    return slices.selectExpr(
        "*",
        f"token_count / greatest(({params_m}) * 1e6D, 1D) AS token_to_param_ratio",
        "1D + coalesce(duplicate_pct, 0D) / 100 * 2 AS duplication_amplifier",
        "token_to_param_ratio / greatest(duplication_amplifier, 1D) AS effective_ratio",
        f"{tier_sql('effective_ratio', K.MEMORIZATION_TIERS, 'MINIMAL')} AS memorization_level",
        "1D / (1D + exp(ln(greatest(effective_ratio, 1e-6D)) * 0.8D)) AS memorization_probability",
        "memorization_probability * 100 AS leakage_score",
        f"{high} AS privacy_flag",
        f"{issues_sql(found)} AS memorization_issues",
        f"{told} AS memorization_advice",
    )


def params_sql(model_size: str = "model_size", ai_type: str = "ai_type") -> str:
    """Parameters in millions; an unknown size counts as Medium, an unknown type as NLP."""
    per_size = {
        size: pick_sql(ai_type, {k: f"{v}D" for k, v in table.items()}, f"{table['NLP']}D")
        for size, table in K.MODEL_PARAMS_M.items()
    }
    return pick_sql(model_size, per_size, per_size["Medium"])


def training_cost(slices: DataFrame) -> DataFrame:
    """Floating-point operations and data sufficiency of slice × scenario rows."""
    short = "(chinchilla_ratio < 0.5 AND token_count > 0)"
    told = advice_sql(
        (short, "Collect the tokens the model size asks for"),
        (short, "Consider a smaller model size"),
        ("total_pflops > 100", "Use mixed precision and gradient checkpointing"),
    )
    return slices.selectExpr(
        "*",
        f"{params_sql()} AS model_params_millions",
        f"model_params_millions * 1e6D * {TOKENS_PER_PARAM}D AS chinchilla_optimal_tokens",
        "token_count / greatest(chinchilla_optimal_tokens, 1D) AS chinchilla_ratio",
        f"{FLOPS_PER_TOKEN_AND_PARAM}D * token_count * (model_params_millions * 1e6D) AS total_flops",
        "total_flops / 1e15D AS total_pflops",
        "CASE WHEN token_count = 0 OR chinchilla_ratio < 0.1 THEN 'CRITICALLY_INSUFFICIENT' "
        "WHEN chinchilla_ratio < 0.5 THEN 'INSUFFICIENT' WHEN chinchilla_ratio < 1 THEN 'MARGINAL' "
        "ELSE 'SUFFICIENT' END AS data_sufficiency",
        f"{told} AS cost_advice",
    )


def gpu_costs(
    costs: DataFrame,
    gpus: Sequence[tuple[str, float, float]] = K.GPUS,
    utilization: float = K.GPU_UTILIZATION,
) -> DataFrame:
    """Hours and dollars per GPU type: one row per slice, scenario and GPU."""
    rows = ", ".join(
        f"named_struct('gpu', {text_sql(name)}, '_tflops', {float(tflops)}D, '_price', {float(price)}D)"
        for name, tflops, price in gpus
    )
    return (
        costs.selectExpr("*", f"inline(array({rows}))")
        .selectExpr(
            "*",
            f"total_flops / (_tflops * 1e12D * {utilization}D * 3600) AS hours",
            "hours * _price AS cost_usd",
        )
        .drop("_tflops", "_price")
    )


def compatibility(cards: DataFrame) -> DataFrame:
    """Fit of slices to scenarios. Needs ``row_count`` (tabular) and ``total_score`` (quality).

    A column ``mismatch_severity`` (see ``domain_mismatch``) adds findings and, if HIGH, takes 20 % off.
    """

    def listed(key: str, value: str, table: dict[str, list[str]], default: str) -> str:
        return pick_sql(
            key,
            {k: f"({value} IN ({', '.join(map(text_sql, v))}))" for k, v in table.items()},
            default,
        )

    def need(slot: int) -> str:
        sizes = {k: f"{v[slot]}L" for k, v in K.SIZE_NEEDS.items()}
        return pick_sql("model_size", sizes, sizes["Medium"])

    def either(tabular: object, text: object) -> str:
        return f"IF(data_type = 'tabular', {tabular}, {text})"

    row_count = "row_count" if "row_count" in cards.columns else "0L"
    wanted = pick_sql(
        "domain", {k: f"{v}D" for k, v in K.DOMAIN_QUALITY.items()}, f"{K.DEFAULT_DOMAIN_QUALITY}D"
    )
    total = " + ".join(f"{name} * {weight}D" for name, weight in FIT_WEIGHTS.items())
    if "mismatch_severity" not in cards.columns:
        cards = cards.selectExpr("*", "'NONE' AS mismatch_severity")
    wrong_kind, unsuited = "type_fit = 0", "architecture_fit < 100"
    short, below = "size_fit < 50", "quality_fit < 100"
    penalty = "mismatch_severity = 'HIGH'"
    found = [
        Issue("mismatch_severity <> 'NONE'", "DOMAIN_MISMATCH", "critical", "_fit", "the data look like another domain"),
        Issue(wrong_kind, "KIND_MISMATCH", "critical", "0", "the AI type does not take this kind of data"),
        Issue(unsuited, "ARCHITECTURE_MISMATCH", "critical", "architecture_fit", "the architecture does not suit the task"),
        Issue(short, "INSUFFICIENT_DATA", "critical", "size_fit", "percent of the recommended size"),
        Issue("size_fit >= 50 AND size_fit < 100", "MARGINAL_DATA", "warning", "size_fit", "percent of the recommended size"),
        Issue(below, "QUALITY_BELOW_DOMAIN", "warning", "coalesce(total_score, 0D)", "quality is below what the domain asks for"),
        Issue(penalty, "DOMAIN_PENALTY", "critical", "compatibility_score", "score lowered for the domain mismatch"),
    ]
    told = advice_sql(
        (wrong_kind, "Choose an AI type that takes this kind of data"),
        (unsuited, "Choose an architecture that suits the task"),
        (short, "Collect more data or choose a smaller model"),
        (below, "Raise the quality to what the domain asks for"),
    )
    kinds = listed("ai_type", "data_type", K.ACCEPTED_KINDS, "(data_type = 'tabular')")
    tasks = listed("architecture", "task_type", K.ARCHITECTURE_TASKS, "false")
    low_quality = clamp_sql("power(coalesce(total_score, 0D) / _wanted, 2.5D) * 100")
    return cards.selectExpr(
        "*",
        f"IF({kinds}, 100D, 0D) AS type_fit",
        f"IF({tasks}, 100D, 30D) AS architecture_fit",
        f"CAST(coalesce({either(row_count, 'token_count')}, 0L) AS BIGINT) AS data_size",
        f"{either(need(0), need(1))} AS required_size",
        f"{clamp_sql('data_size / required_size * 100')} AS size_fit",
        f"{wanted} AS _wanted",
        f"IF(coalesce(total_score, 0D) >= _wanted, 100D, {low_quality}) AS quality_fit",
        f"{clamp_sql(f'IF({wrong_kind}, least({total}, {WRONG_KIND_CAP}D), {total})')} AS _fit",
        f"IF({penalty}, _fit * 0.8D, _fit) AS compatibility_score",
        "CASE WHEN _fit >= 75 THEN 'SUITABLE' WHEN _fit >= 45 THEN 'PARTIALLY_SUITABLE' "
        "ELSE 'NOT_SUITABLE' END AS suitability",
        "CASE WHEN size_fit >= 100 THEN 'ENOUGH' WHEN size_fit >= 50 THEN 'MARGINAL' "
        "ELSE 'NOT_ENOUGH' END AS size_verdict",
        f"{either(text_sql('Recommendation'), text_sql('NLP'))} AS best_ai_type",
        f"CASE WHEN data_size > {either(1_000_000, 500_000_000)} THEN 'Large' "
        f"WHEN data_size > {either(50_000, 25_000_000)} THEN 'Medium' ELSE 'Small' END AS best_model_size",
        "'Transformer' AS best_architecture",
        f"{issues_sql(found, None, ('COMPATIBILITY_OK', 'the data suit the scenario'))} AS compatibility_issues",
        f"{told} AS compatibility_advice",
    ).drop("_fit", "_wanted")


def check_domain(rows: DataFrame) -> DataFrame:
    """Compare the scenario's domain with the detected one, where the cards carry a detection."""
    if "detected_domain" not in rows.columns:
        return rows
    checked = with_mismatch(rows.withColumnRenamed("domain_confidence", "confidence"), "domain")
    return checked.withColumnRenamed("confidence", "domain_confidence").drop("confidences")


def simulate(cards: DataFrame, scenarios: Sequence[dict]) -> DataFrame:
    """Domain check, compatibility, cost and memorization of many scenarios over many slices, in one
    narrow stage."""
    rows = check_domain(with_scenarios(cards, scenarios))
    return memorization(training_cost(compatibility(rows)))
