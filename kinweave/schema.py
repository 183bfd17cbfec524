"""Record schema, configuration and the decision rule."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import types as T

RECORD_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
RECORD = T.StructType([T.StructField(c, T.StringType()) for c in RECORD_COLUMNS])
TRUTH_COLUMNS = ["source1_entity_id", "matched_entity_ids"]


@dataclass(frozen=True)
class BlockingConfig:
    token_cap: int = 250
    bucket_cap: int = 5000
    budget: int = 150
    top_k: int = 60
    max_candidates: int = 80
    min_df: int = 2
    max_features: int = 600_000
    block_token_cap: int = 20_000


@dataclass(frozen=True)
class TrainingConfig:
    seed: int = 42
    negative_ratio: int = 6
    thresholds: tuple[float, ...] = tuple(round(0.20 + 0.02 * i, 2) for i in range(36))
    caps: tuple[int | None, ...] = (1, 2, 3, 4, 6, 8, None)


@dataclass(frozen=True)
class DecisionRule:
    """Either one threshold or one for S2 and one for the rest; cap None is no cap."""

    threshold: float | None = None
    threshold_s2: float | None = None
    threshold_s3: float | None = None
    cap: int | None = None
    bipartite: bool = True

    @property
    def by_source(self) -> bool:
        return self.threshold is None

    def to_json(self) -> str:
        return json.dumps({"mode": "source_specific" if self.by_source else "global"} | {k: v for k, v in asdict(self).items() if v is not None or k == "cap"})

    @classmethod
    def from_json(cls, text: str, threshold: float | None = None, cap: int | None = None) -> DecisionRule:
        """A stored rule; a manual threshold or cap replaces the stored one. A missing bipartite means exclusive."""
        got = json.loads(text)
        own = {k: got.get(k) for k in ("threshold", "threshold_s2", "threshold_s3", "cap")}
        if threshold is not None:
            own |= {"threshold": threshold, "threshold_s2": None, "threshold_s3": None}
        if cap is not None:
            own["cap"] = cap
        return cls(**own, bipartite=bool(got.get("bipartite", True)))
