"""Audit of training data on Spark: profiles, quality scores and risks per slice, as DataFrames."""

from slicewise.operators.confidence import bootstrap_ci, risk_intervals
from slicewise.operators.contamination import (
    fingerprint_match,
    ngram_contamination,
    ngram_overlap,
    phrase_hits,
    table_contamination,
    text_contamination,
)
from slicewise.operators.domain import (
    assign_columns,
    detect_domain,
    domain_mismatch,
    domain_scores,
    value_evidence,
)
from slicewise.operators.fairness import fairness_table, fairness_text
from slicewise.operators.geometry import geometry_scan, nn_distance
from slicewise.operators.groups import group_sufficiency, multi_domain, profile_groups
from slicewise.operators.quality import (
    quality_of_table,
    quality_of_text,
    score_table,
    score_text,
)
from slicewise.operators.quantiles import quantiles
from slicewise.operators.sampling import (
    auto_sample_size,
    hash_sample,
    head_lines,
    sample_fraction,
    top_hash,
)
from slicewise.operators.scenario import (
    compatibility,
    gpu_costs,
    memorization,
    simulate,
    token_counts,
    training_cost,
    with_scenarios,
)
from slicewise.operators.summary import catalog, preview, table_summary, text_summary
from slicewise.operators.table import (
    balance_metrics,
    class_balance,
    column_stats,
    complete_columns,
    correlation,
    coverage,
    custom_stats,
    describe_all,
    duplicates,
    histogram,
    label_moments,
    light_profile,
    light_state,
    merge_states,
    missing,
    null_map,
    numeric_stats,
    profile_table,
)
from slicewise.operators.text import (
    duplicate_lines,
    length_histogram,
    length_outliers,
    line_stats,
    low_entropy,
    profile_text,
    text_vulnerability,
    vocab,
)
from slicewise.plans.audit import audit, audit_table, audit_text, issues, recommendations
from slicewise.sources import lines_of, read_any, read_lines, read_table, write_scorecard

__all__ = [name for name in dir() if not name.startswith("_")]
