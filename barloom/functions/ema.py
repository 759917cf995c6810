"""Recursive exponential moving average as window expressions.

``y[0] = x[0]``, ``y[t] = q*y[t-1] + (1-q)*x[t]`` with ``q = 1 - 2/(span+1)``.
Unrolled, ``y[t]`` is a sum of ``x`` weighted by powers of ``q``.  Inside a
block of rows that sum is a running sum of ``x * q**-j`` scaled by ``q**j``;
the block before contributes through its total.  Blocks further back weigh
less than one unit in the last place and are left out.
"""

from __future__ import annotations

from barloom.operators.panel import Panel, block_rows_for


def _decay(panel: Panel, span: int) -> float:
    q = 1.0 - 2.0 / (span + 1.0)
    # One block must outlast the memory of the average and stay in range.
    if panel.block < block_rows_for(span) or q**panel.block < 1e-300:
        raise ValueError(f"blocks of {panel.block} rows do not fit span {span}")
    return q


def ema_sums(panel: Panel, x: str, span: int, name: str) -> dict[str, str]:
    """The two window sums an average needs; add them before ``ema_value``."""
    q = _decay(panel, span)
    weighted = (
        f"(CASE WHEN idx = 0 THEN {x} ELSE {x} * {1.0 - q!r}D END)"
        f" * pow({q!r}D, -(idx % {panel.block}))"
    )
    return {
        f"_{name}_cur": f"sum({weighted}) OVER {panel.in_block_sql()}",
        f"_{name}_prev": f"sum({weighted}) OVER {panel.previous_block_sql()}",
    }


def ema_value(panel: Panel, span: int, name: str) -> str:
    q = _decay(panel, span)
    carried = f"coalesce(_{name}_prev, 0D) * {q**panel.block!r}D"
    return f"pow({q!r}D, idx % {panel.block}) * (_{name}_cur + {carried})"


def add_ema(panel: Panel, x: str, span: int, name: str) -> Panel:
    """Exponential moving average of one column."""
    panel = panel.add_sql(ema_sums(panel, x, span, name))
    return panel.add_sql({name: ema_value(panel, span, name)})
