"""Parameters of the analyses in one place; every function takes its own as arguments too."""

from __future__ import annotations

from dataclasses import dataclass, field

from repertoire.functions.sequences import DistanceParams
from repertoire.operators.clones import MERGE_QUALITY
from repertoire.operators.diversity import THRESHOLD
from repertoire.operators.filters import CDR3_LENGTHS


@dataclass(frozen=True)
class Parameters:
    """Defaults of a whole analysis."""

    distance: DistanceParams = field(default_factory=DistanceParams)
    distance_threshold: float = THRESHOLD
    cdr3_lengths: tuple[int, int] = CDR3_LENGTHS
    min_quality_for_singletons: int = MERGE_QUALITY
    percentiles: tuple[int, ...] = (5, 10, 25)
    none_score: float = 9.6
    permutations: int = 1000
    tree_leaves: int = 300
