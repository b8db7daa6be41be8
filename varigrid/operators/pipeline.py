"""Steps as ordinary functions on variant frames; all realizations of all steps follow from their inputs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from varigrid.operators.variants import VariantFrame, branch, graft, vjoin
from varigrid.plans import BranchPoint, Plan, in_clause, is_one_off
from varigrid.sources import stored


@dataclass(frozen=True)
class Step:
    """body gets the joined inputs and the parameters.

    inputs name earlier steps, with pins for grafts. To take a step in several times, give each a name of its own and (step, pins) as its
    value; the columns of such an input, but for ``on`` and the branch points, then have that name before theirs.
    """

    name: str
    body: Callable[[VariantFrame, Mapping[str, object]], VariantFrame]
    inputs: Mapping[str, Mapping[str, str] | tuple[str, Mapping[str, str]]] = field(default_factory=dict)
    on: Sequence[str] = ()
    points: Sequence[BranchPoint] = ()
    params: Mapping[str, object] = field(default_factory=dict)

    def sources(self) -> list[tuple[str, str, Mapping[str, str]]]:
        """(name, step, pins) of every input."""
        return [(n, *x) if isinstance(x, tuple) else (n, n, x) for n, x in self.inputs.items()]


def order_steps(steps: Sequence[Step], sources: Sequence[str] = ()) -> list[Step]:
    """The steps so that each comes after its inputs, else as given; a cycle or an input that is no step and no source is an error."""
    names, done, rest = {s.name for s in steps}, set(sources), list(steps)
    if missing := sorted({i for s in steps for _, i, _ in s.sources()} - names - done):
        raise KeyError(f"no step or source {missing}")
    if len(names) < len(steps) or names & done:
        raise ValueError("two steps or sources have one name")
    out: list[Step] = []
    while rest:
        ready = [s for s in rest if all(i in done for _, i, _ in s.sources())]
        if not ready:
            raise ValueError(f"the steps {sorted(s.name for s in rest)} need each other")
        out.append(ready[0])
        done.add(ready[0].name)
        rest.remove(ready[0])
    return out


def relaxed(steps: Sequence[Step]) -> dict[str, dict[str, list[str]]]:
    """The branches that a step or one of its consumers pins, by step and point: a plan need not name them. steps are in order."""
    out: dict[str, dict[str, set[str]]] = {}
    for s in reversed(steps):
        own = out.setdefault(s.name, {})
        for _, i, pins in s.sources():
            for point, branch_ in pins.items():
                own.setdefault(point, set()).add(branch_)
        for _, i, _ in s.sources():
            for point, branches in own.items():
                out.setdefault(i, {}).setdefault(point, set()).update(branches)
    return {s: {p: sorted(b) for p, b in points.items()} for s, points in out.items()}


def _input(vf: VariantFrame, name: str, step: str, pins: Mapping[str, str], on: Sequence[str]) -> VariantFrame:
    own = graft(vf, **pins) if pins else vf
    if name == step:
        return own
    return replace(own, df=own.df.withColumnsRenamed({c: f"{name}_{c}" for c in own.df.columns if c not in on and c not in own.columns}))


def _joined(s: Step, frames: Mapping[str, VariantFrame], on: Sequence[str]) -> VariantFrame:
    """The inputs of a step where their branches agree, with its own points."""
    parts = [_input(frames[step], name, step, pins, on) for name, step, pins in s.sources()]
    return reduce(lambda vf, p: branch(vf, p, into=p.name), s.points, reduce(lambda a, b: vjoin(a, b, on), parts))


def derive(steps: Sequence[Step], sources: Mapping[str, VariantFrame], clause: Mapping | None = None) -> dict[str, VariantFrame]:
    """Run all steps, inputs first: graft the inputs, join them where their branches agree, add own points, filter by the plan clause."""
    out = dict(sources)
    for s in order_steps(steps, list(sources)):
        vf = _joined(s, out, s.on)
        if clause is not None and vf.points:
            vf = vf.where(in_clause(list(vf.points.values()), clause))
        out[s.name] = s.body(vf, s.params)
    return out


def _name(step: str) -> str:
    return f"real_{step}"


def realizations(steps: Sequence[Step], sources: Mapping[str, VariantFrame], accepts: Callable[[str, list[BranchPoint]], Column]) -> dict[str, VariantFrame]:
    """Which realizations each step can have: frames of branch points alone, with the realization of each input as ``real_`` and the input's name.

    steps are in order; ``accepts`` filters those of a step. Sources have the realizations that their rows have. No step is run.
    """
    out = {}
    for name, vf in sources.items():
        rows = vf.df.select(*vf.columns).distinct() if vf.points else vf.df.sparkSession.range(1).select()
        out[name] = replace(vf, df=stored(rows)) if vf.points else replace(vf, df=rows)
    for s in steps:
        named = {i: replace(out[i], df=out[i].named().select(*out[i].columns, F.col("realization").alias(_name("own")))) for _, i, _ in s.sources()}
        parts = []
        for name, step, pins in s.sources():
            own = graft(named[step], **pins) if pins else named[step]
            parts.append(replace(own, df=own.df.withColumnRenamed(_name("own"), _name(name))))
        vf = reduce(lambda v, p: branch(v, p), s.points, reduce(vjoin, parts))
        if vf.points:
            vf = vf.where(accepts(s.name, list(vf.points.values())))
        out[s.name] = replace(vf, df=stored(vf.df.distinct()))
    return out


def planned(steps: Sequence[Step], sources: Mapping[str, VariantFrame], plans: Sequence[Plan] = ()) -> dict[str, DataFrame]:
    """The realizations (column realization) of every step and source that the plans need; steps that no goal needs are absent.

    Three passes for each plan: forwards, the realizations that its clause accepts, with all branches that consumers pin; at its goals those
    that it accepts without them; backwards from there, the realizations of the inputs that made these. A plan that needs nothing is
    an error. Without plans every step has its realizations with at most one branch that is no baseline, or pinned by a consumer.
    """
    steps = order_steps(steps, list(sources))
    relax, needed = relaxed(steps), {}
    if not plans:
        known = realizations(steps, sources, lambda s, points: is_one_off(points, relax[s]))
        return {s: vf.named().select("realization").distinct() for s, vf in known.items()}
    if unknown := sorted({g for p in plans for g in p.goals} - {s.name for s in steps}):
        raise KeyError(f"no step {unknown}")
    for plan in plans:
        known = realizations(steps, sources, lambda s, points, plan=plan: in_clause(points, plan.clause, relax[s]))
        want: dict[str, list[DataFrame]] = {}
        for goal in plan.goals:
            vf = known[goal]
            want.setdefault(goal, []).append(vf.where(in_clause(list(vf.points.values()), plan.clause)).named().select("realization"))
        for s in reversed(steps):
            if s.name in want:
                own = stored(reduce(DataFrame.union, want[s.name]).distinct())
                want[s.name] = [own]
                rows = known[s.name].named().join(own, "realization", "left_semi")
                for name, i, _ in s.sources():
                    want.setdefault(i, []).append(rows.select(F.col(_name(name)).alias("realization")).distinct())
        if all(own[0].isEmpty() for s, own in want.items() if s in plan.goals):
            raise ValueError(f"the plan {plan.name} needs no realization of any step")
        for s, rows in want.items():
            needed.setdefault(s, []).extend(rows)
    return {s: stored(reduce(DataFrame.union, rows).distinct()) for s, rows in needed.items()}


def derive_planned(steps: Sequence[Step], sources: Mapping[str, VariantFrame], plans: Sequence[Plan] = ()) -> dict[str, VariantFrame]:
    """Run what the plans need: the steps on the way to goals, inputs first, each on its planned realizations alone. Steps may be given in any order."""
    need = planned(steps, sources, plans)
    out = {n: _only(vf, need[n]) for n, vf in sources.items() if n in need}
    for s in order_steps(steps, list(sources)):
        if s.name in need:
            out[s.name] = s.body(_only(_joined(s, out, s.on), need[s.name]), s.params)
    return out


def _only(vf: VariantFrame, realizations_: DataFrame) -> VariantFrame:
    """Rows of some realizations; the list is as small as its table, and Spark broadcasts it if that is small enough."""
    if not vf.points:
        return vf
    return replace(vf, df=vf.named().join(realizations_, "realization", "left_semi").drop("realization"))


def observed(vf: VariantFrame, name: str, accept: Column | None = None) -> tuple[VariantFrame, Observation]:
    """Count rows in passing: seen, and accepted and discarded by ``accept``, which keeps the accepted; read ``observation.get`` after an action."""
    o = Observation(name)
    ok = F.lit(True) if accept is None else F.coalesce(accept, F.lit(False))
    df = vf.df.observe(o, F.count(F.lit(1)).alias("seen"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("discarded"))
    return VariantFrame(df if accept is None else df.where(ok), vf.points, vf.masks), o
