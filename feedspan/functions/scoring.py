"""Creator score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of the score.
FOLLOW_WEIGHT = 0.5
LIKE_WEIGHT = 0.3
COMMENT_WEIGHT = 0.2
ENGAGEMENT_WEIGHT = 0.8
CONSISTENCY_WEIGHT = 0.2
RANDOM_WEIGHT = 0.05
CONSISTENCY_MAX = 100.0


def unit_hash(key: Column, seed: str) -> Column:
    """A value in [0, 1) that depends only on the key and the seed, so reruns agree."""
    head = F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(2**32))


def creator_score(
    follows: Column,
    likes: Column,
    comments: Column,
    created: Column,
    gap_days: Column,
    jitter: Column | None = None,
) -> Column:
    """Weighted engagement plus clamped publishing consistency.

    `jitter` in [0, 1) separates equal scores; leave it out for a reproducible score.
    """
    zero = F.lit(0.0)
    num = lambda c: F.coalesce(c.cast("double"), zero)
    engagement = (
        num(follows) * FOLLOW_WEIGHT + num(likes) * LIKE_WEIGHT + num(comments) * COMMENT_WEIGHT
    )
    gap = num(gap_days)
    consistency = F.when(gap != 0, num(created) / gap).otherwise(F.lit(1.0))
    consistency = F.greatest(zero, F.least(F.lit(CONSISTENCY_MAX), consistency))
    score = engagement * ENGAGEMENT_WEIGHT + consistency * CONSISTENCY_WEIGHT
    return score if jitter is None else score + jitter * RANDOM_WEIGHT
