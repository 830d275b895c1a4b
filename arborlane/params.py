"""Training parameters and their checks."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields, replace
from typing import Any

CAST_MODES = ("floor", "ceil", "round")
FIT_MODES = ("width", "depth")
LEVELS = ("MEMORY_AND_DISK", "MEMORY_AND_DISK_SER", "MEMORY_ONLY", "MEMORY_ONLY_SER", "DISK_ONLY", "MEMORY_AND_DISK_2", "MEMORY_ONLY_2", "DISK_ONLY_2", "OFF_HEAP")


@dataclass
class Params:
    """Every knob of a fit. Mutable between rounds by callbacks, through ``update``."""

    max_iter: int = 20
    step_size: float = 0.1
    max_depth: int = 5
    max_bins: int = 256
    max_leaves: int = 1000
    discretization_type: str = "width:round"
    zero_as_missing: bool = False
    cat_cols: tuple[int, ...] = ()
    rank_cols: tuple[int, ...] = ()
    min_gain: float = 0.0
    min_node_hess: float = 1.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    base_score: tuple[float, ...] = ()
    boost_type: str = "gbtree"
    drop_rate: float = 0.0
    drop_skip: float = 0.5
    min_drop: int = 0
    max_drop: int = 50
    sub_sample_rate_by_tree: float = 1.0
    sub_sample_rate_by_node: float = 1.0
    col_sample_rate_by_tree: float = 1.0
    col_sample_rate_by_node: float = 1.0
    sub_sample_type: str = "block"
    top_rate: float = 0.2
    other_rate: float = 0.1
    forest_size: int = 1
    block_size: int = 4096
    leaf_boosting: bool = False
    histogram_computation_type: str = "basic"
    top_k: int = 20
    max_brute_bins: int = 10
    parallelism_type: str = "data"
    histogram_parallelism: int = -1
    checkpoint_interval: int = 10
    aggregation_depth: int = 2
    storage_level1: str = "MEMORY_AND_DISK"
    storage_level2: str = "MEMORY_AND_DISK_SER"
    storage_level3: str = "DISK_ONLY"
    float_type: str = "double"
    seed: int = -1

    def __post_init__(self) -> None:
        self.cat_cols, self.rank_cols, self.base_score = tuple(self.cat_cols), tuple(self.rank_cols), tuple(self.base_score)
        self.check()

    def check(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        unit = lambda x: 0 < x <= 1
        need(self.max_iter >= 0, "max_iter must be at least 0")
        need(self.step_size > 0 and math.isfinite(self.step_size), "step_size must be positive")
        need(1 <= self.max_depth <= 30, "max_depth must be in 1..30")
        need(self.max_bins >= 4, "max_bins must be at least 4")
        need(self.max_leaves >= 2, "max_leaves must be at least 2")
        need(self.min_gain >= 0 and self.min_node_hess >= 0, "min_gain and min_node_hess must not be negative")
        need(self.reg_alpha >= 0 and self.reg_lambda >= 0, "reg_alpha and reg_lambda must not be negative")
        need(all(math.isfinite(x) for x in self.base_score), "base_score must be finite")
        need(len({*self.cat_cols, *self.rank_cols}) == len(self.cat_cols) + len(self.rank_cols), "cat_cols and rank_cols must be distinct")
        need(all(c >= 0 for c in (*self.cat_cols, *self.rank_cols)), "columns must not be negative")
        need(self.boost_type in ("gbtree", "dart"), "boost_type must be gbtree or dart")
        need(0 <= self.drop_rate <= 1 and 0 <= self.drop_skip <= 1, "drop_rate and drop_skip must be in [0, 1]")
        need(0 <= self.min_drop <= self.max_drop, "min_drop must be in [0, max_drop]")
        need(all(map(unit, (self.sub_sample_rate_by_tree, self.sub_sample_rate_by_node, self.col_sample_rate_by_tree, self.col_sample_rate_by_node))), "sample rates must be in (0, 1]")
        need(self.sub_sample_type in ("row", "block", "partition", "goss"), "sub_sample_type must be row, block, partition or goss")
        need(0 < self.top_rate < 1 and 0 < self.other_rate < 1, "top_rate and other_rate must be in (0, 1)")
        need(self.sub_sample_type != "goss" or self.top_rate + self.other_rate <= 1, "top_rate + other_rate must not exceed 1")
        need(self.forest_size > 0 and self.block_size > 0, "forest_size and block_size must be positive")
        need(self.histogram_computation_type in ("basic", "subtract", "vote"), "histogram_computation_type must be basic, subtract or vote")
        need(not (self.leaf_boosting and self.histogram_computation_type == "subtract"), "leaf boosting changes gradients at each level, so histograms can't be subtracted")
        need(self.top_k > 0 and 0 <= self.max_brute_bins <= 64, "top_k must be positive and max_brute_bins in 0..64")
        need(self.parallelism_type in ("data", "feature"), "parallelism_type must be data or feature")
        need(self.histogram_parallelism != 0, "histogram_parallelism must not be 0")
        need(self.checkpoint_interval == -1 or self.checkpoint_interval > 0, "checkpoint_interval must be -1 or positive")
        need(self.aggregation_depth >= 2, "aggregation_depth must be at least 2")
        for level in (self.storage_level1, self.storage_level2, self.storage_level3):
            need(level in LEVELS, f"storage level {level!r} is not one of {', '.join(LEVELS)}")
        need(self.float_type in ("float", "double"), "float_type must be float or double")
        self.modes()

    def modes(self) -> tuple[str, str]:
        """(numerical, categorical and ranking) discretization."""
        first, _, second = self.discretization_type.partition(":")
        second = second or "round"
        if first not in CAST_MODES + FIT_MODES or second not in CAST_MODES:
            raise ValueError(f"discretization_type {self.discretization_type!r} is not mode1[:mode2]")
        return first, second

    def update(self, **given: Any) -> None:
        """Change knobs between rounds; a wrong value leaves all as they were."""
        tried = replace(self, **given)
        for f in fields(self):
            setattr(self, f.name, getattr(tried, f.name))

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)
