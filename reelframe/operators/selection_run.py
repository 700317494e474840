"""The whole selection as stored stages: quality gate, motion flags, keyframe scan, final keyframes.

Stage names and order are "1", "0", "2", "3". Inputs are ``frames`` (raw metrics of every frame) and ``motion`` (motion
fields of sampled frames); with ``steps`` (odometry) the last stage scores candidates by their trajectory too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.operators import selection as K
from reelframe.operators import stationary as St
from reelframe.operators.chain_scan import ChainRules, Scorer, keyframe_scan
from reelframe.operators.keyframes import SelectionParams, chain_scores, stage3_keyframes, thin_and_fill
from reelframe.operators.nearest import inject_motion
from reelframe.operators.quality import quality_gate
from reelframe.session import written_table
from reelframe.sources.runs import Stage


def motion_flags(motion: DataFrame, keys: Sequence[str], *, min_rows: int, grace: int) -> DataFrame:
    """Clear short runs of ``is_stationary`` and mark the rows near the ends of the others."""
    keys = list(keys)
    whole = St.drop_short_runs(motion, keys, min_rows=min_rows)
    return St.boundary_grace(written_table(whole, "motion-flags"), keys, grace=grace)


def selection_stages(
    score: Scorer,
    score_pairs: Callable[[DataFrame], DataFrame],
    columns: Sequence[str],
    keys: Sequence[str] = ("video_id",),
    params: SelectionParams = SelectionParams(),
    *,
    rules: ChainRules | None = None,
    min_still_rows: int = 21,
    grace: int = 2,
    penalty: float = 0.7,
    top_k: int | None = None,
    with_steps: bool = False,
) -> list[Stage]:
    """Stages for :func:`reelframe.sources.runs.run_stages`.

    ``score`` and ``columns`` compare frames inside the scan, ``score_pairs`` scores each keyframe against the one before
    it. ``motion`` has ``is_stationary`` on a dense ``frame_index`` and any motion fields, which candidates take
    from the nearest row. A run whose gate passes no frame ends with stage "1".
    """
    keys, columns = list(keys), list(columns)
    rules = rules or ChainRules(params.min_interval, params.ssim_threshold, params.exposure_threshold)

    def gate(tables):
        return quality_gate(tables["frames"], keys, threshold=params.quality_threshold, abs_min=params.abs_laplacian_min).filter("is_pass")

    def motion(tables):
        return motion_flags(tables["motion"], keys, min_rows=min_still_rows, grace=grace)

    def candidates(tables):
        picked = keyframe_scan(tables["1"], score, keys, columns=columns, rules=rules, span=params.span)
        picked = picked.select(*keys, "frame_index", "is_rescue_mode", "is_forced")
        chain = written_table(tables["1"].join(picked, [*keys, "frame_index"]), "chain")
        scored = chain_scores(chain, score_pairs, keys, span=params.span)
        near = inject_motion(scored, tables["0"].drop("is_stationary", "is_boundary"), keys)
        return St.stationary_penalty(near, tables["0"], keys, penalty=penalty)

    def final(tables):
        kept = thin_and_fill(tables["2"], keys, params)
        if with_steps:
            risk = tables["0"].select(*keys, "frame_index", "motion_risk")
            kept = stage3_keyframes(tables["2"], written_table(kept, "provisional"), tables["steps"], risk, keys, params)
        return kept if top_k is None else K.limit_top_k(kept, keys, top_k)

    settings = asdict(params) | {"keys": keys}
    return [
        Stage("1", gate, ("frames",), {k: settings[k] for k in ("keys", "quality_threshold", "abs_laplacian_min")}, ends_if_empty=True),
        Stage("0", motion, ("motion",), {"keys": keys, "min_still_rows": min_still_rows, "grace": grace}),
        Stage("2", candidates, ("1", "0"), {"keys": keys, "columns": columns, "rules": asdict(rules), "penalty": penalty, "span": params.span}),
        Stage("3", final, ("2", "0", *(("steps",) if with_steps else ())), settings | {"top_k": top_k, "with_steps": with_steps}),
    ]
