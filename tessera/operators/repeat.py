"""Repeated products of one kept matrix by one vector (the reference's timing loop).

The matrix's layout form is prepared (cached) once; each run forces the whole
product with the ``noop`` sink, so nothing is collected. The first run (which
also builds the cached form and starts Python workers for the blocked layout)
is reported apart from the mean of the others.
"""

from __future__ import annotations

import time

from ..matrix import MatrixFrame
from ..vector import VectorFrame


def repeat_multiply(a: MatrixFrame, x: VectorFrame, runs: int = 20, layout: str = "join",
                    trans: bool = False) -> dict:
    """``{"first": s, "mean_rest": s, "runs": [s, ...]}`` wall-clock seconds."""
    if runs < 1:
        raise ValueError("runs must be at least 1")
    times = []
    for k in range(runs):
        t0 = time.perf_counter()
        if k == 0:
            a.prepare(layout, trans)
        y = a.multiply(x, trans=trans, layout=layout, check=(k == 0))
        y.df.write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - t0)
    rest = times[1:]
    return {"first": times[0], "mean_rest": sum(rest) / len(rest) if rest else None, "runs": times}
