"""Pure Column expressions. Nothing here touches a DataFrame or starts a job."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from slicewise.functions import constants as K


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing Unicode white space (``trim`` alone removes only blanks)."""
    return F.btrim(column(c), F.lit(K.WHITESPACE))


def words(c: Column | str) -> Column:
    """Lower-cased words, split on any Unicode white space."""
    return F.filter(F.split(F.lower(column(c)), K.WORD_BREAK), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    """Number of words of an already stripped string."""
    c = column(c)
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, K.WORD_BREAK)))


def name_tokens(c: Column | str) -> Column:
    """Distinct lower-cased parts of a column name."""
    return F.array_distinct(F.split(F.lower(column(c)), r"[_\-\s\.]+"))


def null_if_nan(c: Column | str) -> Column:
    c = column(c)
    return F.when(~F.isnan(c), c)


def clamp_sql(expr: str, lo: float = 0.0, hi: float = 100.0) -> str:
    """Bound a number. Null and NaN stay unknown (``least`` would skip the null and sort NaN highest)."""
    return (
        f"CASE WHEN ({expr}) IS NOT NULL AND NOT isnan({expr}) "
        f"THEN least({hi}D, greatest({lo}D, {expr})) END"
    )


def tier_sql(expr: str, tiers: dict[str, float], default: str = "CRITICAL") -> str:
    """First label whose ceiling lies above the score; a missing score is ``UNKNOWN``."""
    ordered = sorted(tiers.items(), key=lambda t: t[1])
    whens = " ".join(f"WHEN {expr} < {ceiling} THEN '{label}'" for label, ceiling in ordered)
    return f"CASE WHEN ({expr}) IS NULL THEN 'UNKNOWN' {whens} ELSE '{default}' END"


def grade_sql(expr: str) -> str:
    return (
        f"CASE WHEN {expr} >= 85 THEN 'A' WHEN {expr} >= 70 THEN 'B' WHEN {expr} >= 55 THEN 'C' "
        f"WHEN {expr} >= 40 THEN 'D' ELSE 'F' END"
    )


def share_sql(part: str, whole: str) -> str:
    """Percentage of the whole; 0 for an empty whole."""
    return f"CASE WHEN {whole} = 0 THEN 0D ELSE try_divide(CAST({part} AS DOUBLE), {whole}) * 100 END"


def text_sql(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pick_sql(key: str, table: dict[str, object], default: object) -> str:
    """Look a key up in a small constant table; a missing key gets the default."""
    whens = " ".join(f"WHEN {key} = {text_sql(k)} THEN {v}" for k, v in table.items())
    return f"CASE {whens} ELSE {default} END"


def clamp(c: str, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.expr(clamp_sql(c, lo, hi))


def risk_tier(c: str, tiers: dict[str, float], default: str = "CRITICAL") -> Column:
    return F.expr(tier_sql(c, tiers, default))


def grade(c: str) -> Column:
    return F.expr(grade_sql(c))


def share(part: Column | str, whole: Column | str) -> Column:
    part, whole = column(part), column(whole)
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0)) * 100


def _entropy_term(part: Column, whole: Column) -> Column:
    p = part / F.greatest(whole, F.lit(1))
    return p * F.log2(p + F.lit(1e-300))  # 0 for an absent part


def char_entropy(c: Column | str) -> Column:
    """Shannon entropy in bits of the characters of a string, row by row and without a shuffle.

    The characters are sorted and cut into runs of equal ones, whose lengths are the counts.
    """
    c = column(c)
    ordered = F.array_join(F.sort_array(F.split(c, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)((.)\2*)"), F.lit(1))
    # The array of one struct binds the length once instead of once per run.
    bound = F.array(
        F.struct(F.length(c).alias("n"), F.transform(runs, lambda run: F.length(run)).alias("counts"))
    )
    entropy = F.transform(
        bound,
        lambda b: F.aggregate(
            b["counts"], F.lit(0.0), lambda acc, count: acc - _entropy_term(count, b["n"])
        ),
    )
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(F.get(entropy, F.lit(0)))


def low_entropy(c: Column | str, bits: float = 2.0) -> Column:
    """Whether ``char_entropy`` is below ``bits``.

    Merging characters into classes can only lower the entropy, so a string whose classes (a few
    frequent characters, and all others together) already reach ``bits`` is settled by cheap counts;
    the exact value is computed for the rest. The choice of characters affects speed only.
    """
    c = column(c)
    n = F.length(c)
    # They are one byte each: the bytes that go are their number, and only the line itself is read for its length.
    counts = [F.octet_length(c) - F.octet_length(F.replace(c, F.lit(ch), F.lit(""))) for ch in " eaint"]
    rest = n
    bound = F.lit(0.0)
    for count in counts:
        rest = rest - count
        bound = bound - _entropy_term(count, n)
    bound = bound - _entropy_term(rest, n)
    return F.when((n > 0) & (bound > bits + 1e-9), F.lit(False)).otherwise(char_entropy(c) < bits)


def fingerprint(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of a row: a 16-byte grouping key for rows or lines of any width.

    Null flags are hashed along with the values, because ``xxhash64`` passes over nulls. The second
    hash starts from another seed. Grouping on 128 bits instead of the values keeps the shuffle small;
    two different rows among 10^13 share both hashes with a probability below 10^-12.
    """
    parts: list[Column] = []
    for c in cols:
        parts += [c.isNull(), c]
    return [
        F.xxhash64(*parts).alias("_fp1"),
        F.xxhash64(F.lit(1), *parts).alias("_fp2"),
    ]


def key_md5(keys: Sequence[str]) -> Column:
    """md5 of the key columns: the same order and the same sample for any partitioning.

    Every value is written with its length, so no two different keys read alike; a null is ``n``."""
    values = [F.col(f"`{k}`").cast("string") for k in keys]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("n")) for v in values]))


def normal_quantile(level: float) -> float:
    return K.Z_95 if level == 0.95 else NormalDist().inv_cdf(1 - (1 - level) / 2)


def risk_ci(
    score: Column | str,
    n: Column | str | int = K.RISK_SAMPLE,
    level: float = 0.95,
    variance: float = K.RISK_VARIANCE,
) -> Column:
    """Normal-approximation interval of a risk score, clamped to [0, 100], as one struct.

    A sample of one or less has no width; a missing score has no interval.
    """
    score = column(score).cast("double")
    n = F.lit(n) if isinstance(n, int) else column(n)
    n = F.coalesce(n, F.lit(K.RISK_SAMPLE))
    error = F.when(n <= 1, F.lit(0.0)).otherwise(F.sqrt(F.lit(variance) / F.greatest(n, F.lit(1))))
    margin = error * F.lit(normal_quantile(level))
    return F.when(
        score.isNotNull(),
        F.struct(
            score.alias("point_estimate"),
            F.when(n <= 1, score).otherwise(F.greatest(F.lit(0.0), score - margin)).alias("lower_bound"),
            F.when(n <= 1, score).otherwise(F.least(F.lit(100.0), score + margin)).alias("upper_bound"),
            F.lit(level).alias("confidence_level"),
            error.alias("standard_error"),
        ),
    )


def text_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
