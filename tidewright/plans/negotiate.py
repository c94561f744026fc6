"""Guarantee negotiation: the weakest of what is asked and what source, sink and store can hold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, weakest first.
TIERS = ("at_most_once", "at_least_once", "effectively_once", "exactly_once")
ACK_POINTS = ("write", "flush", "commit", "token")


@dataclass
class SourceCaps:
    replayable: bool = True
    redelivers: bool = False
    stable_keys: bool = True
    complete_images: bool = True


@dataclass
class SinkCaps:
    commits: bool = False
    stores_token: bool = False
    idempotent: bool = False
    flushes: bool = False
    modes: tuple[str, ...] = ("append",)
    needs_whole_images: bool = False
    fails_per_record: bool = True
    needs_keys: bool = False


#: What a store's content outlives, least first.
DOMAINS = ("nothing", "process", "node", "cluster")


@dataclass
class StoreCaps:
    durable_writes: bool = True
    compare_and_set: bool = True
    fences_epochs: bool = True
    atomic_keys: bool = True
    outlives: str = "node"


@dataclass
class Contract:
    tier: str
    ack_point: str
    edge: str | None
    why: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Gap:
    """Something that is asked for and that a component does not declare. ``missing`` is its token; without one it cannot be waived."""

    node: str
    missing: str
    message: str


def capability_gaps(asked: str, sources: dict[str, SourceCaps], sinks: dict[str, SinkCaps], streams: Callable[[str], list[dict]] = lambda node: []) -> list[Gap]:
    """What the sinks' declarations leave open, by node; ``streams``: the stream entries that hold at a node."""
    out = []
    for node, c in sorted(sinks.items()):
        if asked == "exactly_once" and not (c.commits or c.stores_token):
            out.append(Gap(node, "commits", f"{node}: exactly_once is asked for, and the sink neither commits nor stores a token"))
        if asked == "effectively_once" and not (c.idempotent or c.commits or c.stores_token):
            out.append(Gap(node, "idempotent", f"{node}: effectively_once is asked for, and the sink is not idempotent"))
        if c.needs_whole_images and not all(s.complete_images for s in sources.values()):
            out.append(Gap(node, "complete_images", f"{node}: the sink needs whole images, and a source may send partial ones"))
        if c.needs_keys and not all(s.stable_keys for s in sources.values()):
            out.append(Gap(node, "stable_keys", f"{node}: the sink needs a key, and a source does not declare stable ones"))
        for entry in streams(node):
            if entry.get("write", "append") not in c.modes:
                out.append(Gap(node, "", f"{node}: stream {entry['stream']!r} is to be written by {entry['write']}; the sink has {', '.join(c.modes)}"))
            if entry.get("dedupe") is not None and not entry["dedupe"].get("window_us"):
                out.append(Gap(node, "", f"{node}: stream {entry['stream']!r}: a dedupe window is required and has no default"))
    return out


def apply_waivers(gaps: list[Gap], waivers: list[dict]) -> tuple[list[str], list[str]]:
    """(errors, warnings): a waiver (node, missing, acknowledged_by, reason) turns the gaps it names, at exactly its node, into warnings.

    One that names nothing, or is not signed and explained, is an error and waives nothing; one that no gap needs is a warning.
    """
    errors, warnings, used = [], [], set()
    sound = {n for n, w in enumerate(waivers) if w.get("missing") and w.get("acknowledged_by") and w.get("reason")}
    for gap in gaps:
        by = next((n for n in sorted(sound) if gap.missing and waivers[n].get("node") == gap.node and gap.missing in waivers[n]["missing"]), None)
        if by is None:
            errors.append(gap.message)
        else:
            used.add(by)
            warnings.append(f"{gap.message}; waived by {waivers[by]['acknowledged_by']}: {waivers[by]['reason']}")
    for n, w in enumerate(waivers):
        if not w.get("missing"):
            errors.append(f"waivers[{n}]: it must name what is missing")
        elif n not in sound:
            errors.append(f"waivers[{n}]: it must say who acknowledged it, and why")
        elif n not in used:
            warnings.append(f"waivers[{n}]: nothing needs it at {w.get('node')}")
    return errors, warnings


def source_ceiling(c: SourceCaps) -> str:
    if not (c.replayable or c.redelivers):
        return TIERS[0]
    return TIERS[3] if c.stable_keys else TIERS[1]


def sink_ceiling(c: SinkCaps) -> str:
    return TIERS[3] if c.commits or c.stores_token else TIERS[2] if c.idempotent else TIERS[1]


def store_ceiling(c: StoreCaps) -> tuple[str | None, str]:
    """(the strongest tier the store carries, why no more); None where it carries none at all.

    Above at_least_once what collapses duplicates is kept in the store, so it must outlive the process and be written in one piece with the cursor;
    below, losing it only means reading again.
    """
    if not c.durable_writes:
        return None, "a write to the store may not be durable when it returns"
    if not (c.compare_and_set and c.fences_epochs):
        return None, "without compare-and-set and epoch fencing two workers could write one lane's progress"
    if DOMAINS.index(c.outlives) < DOMAINS.index("node"):
        return TIERS[1], "the store does not outlive a restart"
    return (TIERS[3], "") if c.atomic_keys else (TIERS[1], "the store cannot write several keys in one piece")


def ack_point(c: SinkCaps) -> str:
    return "token" if c.stores_token else "commit" if c.commits else "flush" if c.flushes else "write"


def weakest(*tiers: str) -> str:
    return min(tiers, key=TIERS.index)


def negotiate(asked: str, sources: dict[str, SourceCaps], sinks: dict[str, SinkCaps], best_effort: set[str] = frozenset(), store: StoreCaps | None = None) -> Contract:
    """The pipeline's contract is that of its weakest branch that is not best effort; ties go to the first node id. A store that carries no tier is refused."""
    why = []
    ceiling = asked
    for name, caps in sorted(sources.items()):
        if TIERS.index(source_ceiling(caps)) < TIERS.index(ceiling):
            ceiling = source_ceiling(caps)
            why.append(f"source {name} holds no more than {ceiling}")
    carried, reason = store_ceiling(store or StoreCaps())
    if carried is None:
        raise ValueError(reason)
    if TIERS.index(carried) < TIERS.index(ceiling):
        ceiling = carried
        why.append(reason)
    bound = [(TIERS.index(weakest(ceiling, sink_ceiling(caps))), name) for name, caps in sorted(sinks.items()) if name not in best_effort]
    if not bound:
        return Contract(ceiling, "write", None, why)
    tier, name = min(bound)
    if tier < TIERS.index(ceiling):
        why.append(f"sink {name} holds no more than {TIERS[tier]}")
    return Contract(TIERS[tier], ack_point(sinks[name]), name, why)


def tier_columns(asked: Column, replayable: Column, redelivers: Column, keys: Column, commits: Column, idempotent: Column) -> Column:
    """The same rule over a table of combinations."""
    source = F.when(~replayable & ~redelivers, 0).when(~keys, 1).otherwise(3)
    sink = F.when(commits, 3).when(idempotent, 2).otherwise(1)
    return F.element_at(F.array(*map(F.lit, TIERS)), (F.least(asked, source, sink) + 1).cast("int"))
