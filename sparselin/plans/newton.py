"""Trust-region Newton with truncated conjugate gradients.

The driver only decides; every evaluation of the objective, its gradient or a
Hessian-vector product is a pass over the data by the ``problem``. An outer iteration
with c inner steps costs c + 1 passes: value and gradient share one, and the
predicted reduction follows from the inner residual without another product.

The method is a generator of what it needs to know: passes, and arithmetic on
vectors, which may be tables themselves. So many fits can run in lockstep and share both.
"""

from __future__ import annotations

import logging
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any


LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class NewtonOptions:
    # Stopping rule, region thresholds and region factors.
    eps: float = 1e-2
    max_iter: int = 100
    cg_tol_factor: float = 0.5
    eta1: float = 0.25
    eta2: float = 0.75
    sigma1: float = 0.25
    sigma2: float = 2.0
    delta_init: float | None = None
    delta_max: float | None = None


# Smallest accepted ratio, and tolerances of a vanishing step and of a step on the border.
ACCEPT_RATIO = 1e-4
NO_STEP = 1e-8
ON_BORDER = {"rel_tol": 1e-7, "abs_tol": 1e-12}


@dataclass
class NewtonResult:
    w: Any
    f: float
    g_norm: float
    delta: float
    iters: int
    reason: str
    f0: float
    g0_norm: float
    history: list[dict] = field(default_factory=list)


# What a run may ask for besides passes over the data.
ARITHMETIC = ("combine", "dots")


def _along(dd: float, pd: float, pp: float, delta: float) -> float:
    """The step along ``d`` from ``p`` inside the ball that ends on its border, from their inner products."""
    if dd == 0:
        return 0.0
    return (math.sqrt(max(0.0, pd * pd + dd * (delta * delta - pp))) - pd) / dd


def newton_step(problem, w, g, delta: float, tol: float):
    """Approximately minimise the quadratic model within the ball of radius ``delta``.

    Yields ``("product", w, d)`` for each Hessian-vector product it needs, and requests of
    ``ARITHMETIC``. Returns the step, its norm, the predicted reduction and the number of inner iterations.
    """
    p = problem.zeros()
    r, = yield "combine", [(p, -1.0, g, "residual")]
    d, (rr,) = r, (yield "dots", [(r, r)])
    steps, norm = 0, 0.0
    while rr > 0:
        steps += 1
        z = yield "product", w, d
        bend, = yield "dots", [(d, z)]
        alpha = rr / bend if bend > 0 else 1.0
        beyond, rest = yield "combine", [(p, alpha, d, "step"), (r, -alpha, z, "residual")]
        square, = yield "dots", [(beyond, beyond)]
        norm = math.sqrt(square)
        if norm > delta:
            alpha = _along(*(yield "dots", [(d, d), (p, d), (p, p)]), delta)
            p, r = yield "combine", [(p, alpha, d, "border step"), (r, -alpha, z, "border residual")]
            square, = yield "dots", [(p, p)]
            norm = math.sqrt(square)
            break
        p, r = beyond, rest
        rr_before, (rr,) = rr, (yield "dots", [(r, r)])
        if math.sqrt(rr) <= tol:
            break
        d, = yield "combine", [(r, rr / rr_before, d, "direction")]
    # r = -g - Hp, hence -(g·p + p·Hp / 2) = (r·p - g·p) / 2.
    rp, gp = yield "dots", [(r, p), (g, p)]
    return p, norm, 0.5 * (rp - gp), steps


def first_radius(g_norm: float, o: NewtonOptions) -> float:
    delta = max(1.0, g_norm) if o.delta_init is None else o.delta_init
    return delta if o.delta_max is None else min(delta, o.delta_max)


def next_radius(delta: float, ratio: float, step_norm: float, o: NewtonOptions) -> float:
    """Shrink after a poor prediction; grow after a good one whose step ends on the border."""
    if ratio < o.eta1:
        return delta * o.sigma1
    if ratio > o.eta2 and math.isclose(step_norm, delta, **ON_BORDER):
        return min(o.sigma2 * delta, o.delta_max or math.inf)
    return delta


def is_accepted(ratio: float, gained: float) -> bool:
    return ratio > ACCEPT_RATIO and gained > 0


def is_converged(g_norm: float, g0_norm: float, o: NewtonOptions) -> bool:
    return g_norm <= o.eps * max(1.0, g0_norm)


def observed(callback: Callable[[dict], None] | None, row: dict) -> None:
    """Show a step to an observer; a broken one is reported and does not end a long fit."""
    if callback is None:
        return
    try:
        callback(dict(row))
    except Exception:
        LOG.warning("the observer of iteration %s failed", row["iter"], exc_info=True)


def iterations(problem, w0=None, options: NewtonOptions | None = None, callback: Callable[[dict], None] | None = None,
               resumed: NewtonResult | None = None, keep: Callable[[NewtonResult], None] | None = None, **overrides):
    """The method as a generator of what it needs to know, so that fits can share passes over the data.

    Yields ``("value", w)``, to be answered by value and gradient, ``("product", w, d)``, to be
    answered by a Hessian-vector product, ``("combine", list)`` of ``(a, scale, b, kind)`` for a + scale * b, where ``kind``
    says which of the solver's vectors it is a version of, and ``("dots", pairs)`` for inner products. Returns the result.
    ``keep`` gets the state after every accepted step; a run that starts from such a state, ``resumed``, goes on as the
    one that made it would have.
    """
    o = replace(options or NewtonOptions(), **overrides)
    w = resumed.w if resumed else problem.zeros() if w0 is None else w0
    start = time.time() - (resumed.history[-1]["t_sec"] if resumed else 0.0)
    f, g = yield "value", w
    problem.hold("weights", "gradient")
    if resumed:
        state = replace(resumed, f=f, reason="max_iter", history=list(resumed.history))
        norm0 = state.g0_norm
        if is_converged(state.g_norm, norm0, o):
            state.reason = "grad_tol"
            return state
    else:
        norm0 = math.sqrt((yield "dots", [(g, g)])[0])
        state = NewtonResult(w, f, norm0, first_radius(norm0, o), 0, "max_iter", f, norm0)
    if norm0 == 0.0:
        state.reason = "g0 == 0"
        return state

    while state.iters < o.max_iter:
        tol = min(0.5, math.sqrt(state.g_norm)) * state.g_norm * o.cg_tol_factor
        p, p_norm, predicted, cg = yield from newton_step(problem, state.w, g, state.delta, tol)
        if problem.largest(p) <= NO_STEP:
            state.reason = "p ~ 0"
            return state

        candidate, = yield "combine", [(state.w, 1.0, p, "weights")]
        f_new, g_new = yield "value", candidate
        gained = state.f - f_new
        ratio = gained / predicted if predicted > 0 else -math.inf
        state.delta = next_radius(state.delta, ratio, p_norm, o)
        accepted = is_accepted(ratio, gained)
        if accepted:
            state.w, state.f, g = candidate, f_new, g_new
            problem.hold("weights", "gradient")
            state.g_norm = math.sqrt((yield "dots", [(g, g)])[0])
        state.iters += 1
        state.history.append({
            "iter": state.iters, "f": state.f, "g_norm": state.g_norm, "delta": state.delta,
            "actred": gained, "prered": predicted, "ratio": ratio, "cg": cg,
            "accepted": accepted, "t_sec": time.time() - start,
        })
        observed(callback, state.history[-1])
        if accepted and keep is not None:
            keep(state)
        if is_converged(state.g_norm, norm0, o):
            state.reason = "grad_tol"
            return state
    return state


def answered(problem, request: tuple):
    """What ``problem`` says to a request of ``iterations``."""
    kind, *what = request
    if kind == "dots":
        return [problem.dot(a, b) for a, b in what[0]]
    if kind == "combine":
        return [problem.combine(*one) for one in what[0]]
    return problem.value_and_gradient(*what) if kind == "value" else problem.hessian_vector(*what)


def minimize(
    problem,
    w0=None,
    options: NewtonOptions | None = None,
    callback: Callable[[dict], None] | None = None,
    **overrides,
) -> NewtonResult:
    """Minimise ``problem`` from ``w0`` (default 0); ``overrides`` replace single options."""
    return minimize_together([iterations(problem, w0, options, callback, **overrides)],
                             lambda pending: [answered(problem, request) for _, request in pending])[0]


def minimize_together(runs: list, answers: Callable[[list[tuple[int, tuple]]], list]) -> list[NewtonResult]:
    """Run several ``iterations`` in lockstep.

    ``answers`` gets pending requests of unfinished runs, with their places, and
    answers all of them, for instance from one pass over the data. Arithmetic comes
    first, so that all runs wait for a pass when one is made.
    """
    results: list[NewtonResult | None] = [None] * len(runs)
    pending: list[tuple[int, tuple]] = []

    def advance(i: int, answer) -> None:
        try:
            pending.append((i, runs[i].send(answer)))
        except StopIteration as end:
            results[i] = end.value

    for i in range(len(runs)):
        advance(i, None)
    while pending:
        asked = [p for p in pending if p[1][0] in ARITHMETIC] or list(pending)
        pending[:] = [p for p in pending if not any(p is a for a in asked)]
        for (i, _), answer in zip(asked, answers(asked)):
            advance(i, answer)
    return results
