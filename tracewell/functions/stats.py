"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution.
Z95 = 1.959963984540054
#: Fixed values of the rising-terms score: the prior's mass is at most PRIOR_MASS, and this share of the messages.
PRIOR_MASS, PRIOR_SHARE = 500.0, 0.10


def wilson(x: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval for x successes in n > 0 trials (null where n is 0)."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = x / n
    d = 1 + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / d
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / d
    known = lambda bound: F.when(n.isNotNull(), bound)  # noqa: E731  greatest and least pass over nulls
    return known(F.greatest(F.lit(0.0), centre - half)), known(F.least(F.lit(1.0), centre + half))


def count_band(total: Column, squares: Column, k: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """(mean, low, high) of k daily counts, from their sum and sum of squares; never narrower than Poisson."""
    k = k.cast("double")
    mean = total / k
    variance = F.when(k > 1, F.greatest(F.lit(0.0), (squares - total * total / k) / (k - 1))).otherwise(F.lit(0.0))
    half = F.lit(z) * F.sqrt(F.greatest(variance, mean) / k)
    return mean, F.greatest(F.lit(0.0), mean - half), mean + half


def log_odds(n: Column, before: Column, total: Column, total_before: Column) -> tuple[Column, Column]:
    """(log-odds difference, its standard error) of a term's n of ``total`` messages against
    ``before`` of ``total_before``, with an informative Dirichlet prior."""
    both = total + total_before
    mass = F.least(F.lit(PRIOR_MASS), F.greatest(F.lit(PRIOR_SHARE) * both, F.lit(1.0)))
    a = mass * (n + before) / both
    odds = lambda x, of: F.ln((x + a) / F.greatest(of + mass - x - a, F.lit(1e-9)))
    return odds(n, total) - odds(before, total_before), F.sqrt(1 / (n + a) + 1 / (before + a))


def js_part(a: Column, b: Column) -> Column:
    """One outcome's share of the Jensen-Shannon divergence (base 2) of probabilities a and b."""
    m = (a + b) / 2
    term = lambda p: F.when(p > 0, 0.5 * p * F.log2(p / m)).otherwise(F.lit(0.0))
    return term(a) + term(b)


def entropy(text: Column) -> Column:
    """Shannon entropy, in bits per character, of a short string (null if empty)."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.nullif(F.size(chars).cast("double"), F.lit(0.0))
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)) + 0 * n
