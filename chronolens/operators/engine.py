"""Grouping a day's events into activities and contexts.

The fold is sequential by nature (each decision depends on the ones before), so it runs in Arrow batches of rows sorted by (session_id, work_day), a day
being bounded by what one person does in it; an index of anchors keeps its time near the number of events. Everything around it (anchors, keywords, spans, names) is relational.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pretty
from . import anchors as A
from .intervals import covered_ms

KEYS = ["session_id", "work_day"]
#: These events end an activity and belong to none.
HARD_BOUNDARY = ["system.idle.start", "system.session.lock", "system.power.sleep", "system.capture.paused"]
NAMES_BY_SOURCE = {"external": "Cockpit", "terminal": "Terminal", "git": "Git"}
AGENT_NAME = "Claude Code"
#: Names of applications by their ids.
APP_NAMES = {
    "com.tinyspeck.slackmacgap": "Slack", "com.linear": "Linear", "com.figma.Desktop": "Figma", "com.apple.Notes": "Notes", "com.apple.mail": "Mail", "com.apple.finder": "Finder",
    "com.apple.Terminal": "Terminal", "com.googlecode.iterm2": "iTerm2", "com.google.Chrome": "Chrome", "com.apple.Safari": "Safari", "com.acme.cockpit": "Cockpit", "com.apple.Preview": "Preview",
    "com.microsoft.VSCode": "VS Code", "Code.exe": "VS Code", "chrome.exe": "Chrome", "WindowsTerminal.exe": "Terminal", "slack.exe": "Slack", "Teams.exe": "Teams", "olk.exe": "Outlook",
    "explorer.exe": "Finder", "Spotify.exe": "Spotify",
}


@dataclass(frozen=True)
class EngineConfig:
    """Fixed values of the method as defaults, in milliseconds."""

    activity_gap: int = 90_000
    activity_longest: int = 20 * 60_000
    drift: int = 10 * 60_000
    threshold: float = 0.22
    half_life: int = 3 * 3_600_000
    least_events: int = 2
    continuation: int = 120_000


Anchor = tuple[str, str, float]  # type, norm, confidence


@lru_cache(maxsize=65_536)
def _parts(norm: str) -> frozenset[str]:
    return frozenset(p for p in norm.split("-") if len(p) >= 4)


class View:
    """Anchors as sets, for matching others against them. Whether equal norms of different types match depends on the other's type alone."""

    def __init__(self, anchors: list[Anchor]):
        self.exact = {(kind, norm) for kind, norm, _ in anchors}
        self.norms = {norm for _, norm, _ in anchors}
        self.parts = set().union(*(_parts(norm) for kind, norm, _ in anchors if kind in A.LOOSE))
        self.identity = {kind: {norm for k, norm, _ in anchors if k == kind} for kind in A.IDENTITY}

    def holds(self, a: Anchor) -> bool:
        return (a[0], a[1]) in self.exact or a[0] in A.LOOSE and (a[1] in self.norms or not self.parts.isdisjoint(_parts(a[1])))

    def conflicts(self, other: View) -> bool:
        """Both sides have an identity of one type and none of it is the same."""
        return any(mine and other.identity[kind] and mine.isdisjoint(other.identity[kind]) for kind, mine in self.identity.items())


def _shared(xs: list[Anchor], ys: View) -> list[Anchor]:
    return [a for a in xs if ys.holds(a)]


def _strength(a: Anchor) -> str:
    return "strong" if a[0] in A.STRONG else "medium" if a[0] in A.MEDIUM else "weak"


@dataclass
class Group:
    """An activity or a context: its events by position, span, applications and anchors in order of first sight."""

    number: int
    start: int
    end: int
    events: list[int] = field(default_factory=list)
    apps: dict[str, None] = field(default_factory=dict)
    anchors: dict[tuple[str, str], float] = field(default_factory=dict)
    anchored: int = 0
    members: list[int] = field(default_factory=list)
    _view: View | None = None

    def listed(self) -> list[Anchor]:
        return [(t, n, c) for (t, n), c in self.anchors.items()]

    def view(self) -> View:
        if self._view is None:
            self._view = View(self.listed())
        return self._view

    def take(self, start: int, end: int, apps, anchors) -> None:
        self.start, self.end = min(self.start, start), max(self.end, end)
        self.apps.update(dict.fromkeys(apps))
        for kind, norm, c in anchors:
            if (kind, norm) not in self.anchors:
                self._view = None
            self.anchors[kind, norm] = max(c, self.anchors.get((kind, norm), 0.0))


def activities(events: list[dict], config: EngineConfig) -> list[Group]:
    """events in order, each with ts, end, type, app, anchors."""
    done: list[Group] = []
    now: Group | None = None
    for i, e in enumerate(events):
        if e["type"] in HARD_BOUNDARY:
            now = None
            continue
        if now and (e["ts"] - now.end > config.activity_gap or e["end"] - now.start > config.activity_longest):
            now = None
        if now:
            held, named = e["app"] in now.apps, any(kind in A.IDENTITY for kind, _, _ in e["anchors"])
            if named or not held:  # else neither what the last events hold nor a conflict changes anything
                seen = View(list({(a[0], a[1]): a for k in reversed(now.events[-3:]) for a in events[k]["anchors"]}.values()))
                if not (held or any(map(seen.holds, e["anchors"]))) or named and View(e["anchors"]).conflicts(seen):
                    now = None
        if now is None:
            now = Group(len(done) + 1, e["ts"], e["end"])
            done.append(now)
        now.events.append(i)
        now.take(e["ts"], e["end"], [e["app"]], e["anchors"])
        now.start = min(now.start, events[now.events[0]]["ts"])
    return done


def affinity(act: Group, ctx: Group, config: EngineConfig, continues: bool) -> float:
    """How well an activity fits a context; continues: the context holds the activity before, and its last application goes on."""
    mine, theirs = act.listed(), ctx.view()
    shared = _shared(mine, theirs)
    kinds = {_strength(a) for a in shared}
    if "strong" not in kinds and act.view().conflicts(theirs):
        return 0.0
    gap = max(0, act.start - ctx.end)
    if not shared:
        if not mine:
            drift = max(0, act.end - ctx.anchored) if ctx.anchors else gap
            return config.threshold * (1 - drift / config.drift) if drift < config.drift else 0.0
        return config.threshold if continues and gap < config.continuation else 0.0
    weak = len({a[1] for a in shared if _strength(a) == "weak"})
    recency = 0.5 ** (gap / config.half_life)
    raw = 0.5 * (1 if "strong" in kinds else 0.7 if "medium" in kinds else 0) + 0.28 * min(1, weak / 2) + 0.14 * recency + 0.04 * any(a in ctx.apps for a in act.apps)
    return raw if "strong" in kinds else raw * (0.4 + 0.6 * recency)


def _absorb(host: Group, other: Group) -> None:
    host.take(other.start, other.end, other.apps, other.listed())
    host.anchored = max(host.anchored, other.anchored)
    host.events += other.events
    host.members += other.members


class Index:
    """Which contexts have what anchors: by anchor, by norm, by norm and by part of the loose ones. Contexts go by number; of joined ones the number that goes on stands for the other."""

    def __init__(self) -> None:
        self.exact: dict[tuple[str, str], set[int]] = {}
        self.norms: dict[str, set[int]] = {}
        self.loose: dict[str, set[int]] = {}
        self.parts: dict[str, set[int]] = {}
        self.into: dict[int, int] = {}

    def add(self, number: int, anchors: list[Anchor]) -> None:
        for kind, norm, _ in anchors:
            self.exact.setdefault((kind, norm), set()).add(number)
            self.norms.setdefault(norm, set()).add(number)
            if kind in A.LOOSE:
                self.loose.setdefault(norm, set()).add(number)
                for part in _parts(norm):
                    self.parts.setdefault(part, set()).add(number)

    def join(self, host: int, other: int) -> None:
        self.into[other] = host

    def _now(self, *found: set[int]) -> set[int]:
        if not self.into:
            return set().union(*found)
        out = set()
        for number in set().union(*found):
            end = number
            while end in self.into:
                end = self.into[end]
            while self.into.get(number, end) != end:
                number, self.into[number] = self.into[number], end
            out.add(end)
        return out

    def holding(self, anchors: list[Anchor]) -> set[int]:
        """Contexts whose view holds one of the anchors."""
        none: set[int] = set()
        found = []
        for kind, norm, _ in anchors:
            found.append(self.exact.get((kind, norm), none))
            if kind in A.LOOSE:
                found += [self.norms.get(norm, none), *(self.parts.get(p, none) for p in _parts(norm))]
        return self._now(*found)

    def held_by(self, anchors: list[Anchor]) -> set[int]:
        """Contexts that have an anchor which a view of these would hold."""
        none: set[int] = set()
        found = []
        for kind, norm, _ in anchors:
            found += [self.exact.get((kind, norm), none), self.loose.get(norm, none)]
            if kind in A.LOOSE:
                found += [self.parts.get(p, none) for p in _parts(norm)]
        return self._now(*found)


class Reach:
    """Greatest values over ranges of places (a tree of maxima)."""

    def __init__(self, values: list[float]):
        self.size = 1 << max(0, len(values) - 1).bit_length()
        self.tree = [-1.0] * self.size + values + [-1.0] * (self.size - len(values))
        for k in range(self.size - 1, 0, -1):
            self.tree[k] = max(self.tree[2 * k], self.tree[2 * k + 1])

    def put(self, at: int, value: float) -> None:
        at += self.size
        self.tree[at] = value
        while at > 1:
            at //= 2
            self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])

    def first_above(self, value: float, until: int) -> int | None:
        """The first place before `until` whose value is greater."""
        stack = [(1, 0, self.size)]
        while stack:
            k, lo, width = stack.pop()
            if lo >= until or self.tree[k] <= value:
                continue
            if width == 1:
                return lo
            stack += [(2 * k + 1, lo + width // 2, width // 2), (2 * k, lo, width // 2)]
        return None


def contexts(acts: list[Group], config: EngineConfig) -> list[Group]:
    """Greedy assignment, then merging by shared anchors, then what lies inside an anchored context without an identity of its own.

    Only contexts that can be chosen are looked at, in the order of their numbers: those that share an anchor and the one before, or, for an activity without anchors, those that reach up to it."""
    found: list[Group] = []
    index, near = Index(), set()
    before: tuple[Group, str] | None = None
    for act in acts:
        first, mine = next(iter(act.apps)), act.listed()
        if mine:
            known = index.holding(mine) | ({before[0].number} if before else set())
        else:  # what an activity can do without anchors is go on where a context reaches up to it; starts never fall, so others are out for good
            near = {n for n in near if (c := found[n - 1]) and (c.anchored if c.anchors else c.end) >= act.start}
            known = near
        best, most = None, 0.0
        for number in sorted(known):
            ctx = found[number - 1]
            fit = affinity(act, ctx, config, before is not None and before[0] is ctx and before[1] == first)
            if fit > most:
                best, most = ctx, fit
        if best is None or most < config.threshold:
            best = Group(len(found) + 1, act.start, act.end, anchored=act.start)
            found.append(best)
        new = [a for a in mine if a[:2] not in best.anchors]
        best.take(act.start, act.end, act.apps, mine)
        index.add(best.number, new)
        near.add(best.number)
        if act.anchors:
            best.anchored = max(best.anchored, act.end)
        best.events += act.events
        best.members.append(act.number)
        before = (best, list(act.apps)[-1])

    if len(found) < 2:
        return found

    def fits(a: Group, b: Group) -> bool:
        return any(map(b.view().holds, a.listed())) and not a.view().conflicts(b.view())

    live = {c.number for c in found}
    i = 1
    while i <= len(found):  # the first pair that fits is joined, until none does; only pairs with what has changed are looked at again
        if i not in live:
            i += 1
            continue
        one = found[i - 1]
        j = next((k for k in sorted(index.holding(one.listed())) if k > i and fits(one, found[k - 1])), None)
        if j is None:
            i += 1
            continue
        _absorb(one, found[j - 1])
        index.join(i, j)
        live.discard(j)
        i = next((k for k in sorted(index.held_by(one.listed())) if k < i and fits(found[k - 1], one)), i)

    # hosts only become fewer and none reaches farther, so that one pass in order finds what passes that begin anew do
    starts = [c.start for c in found]  # they never fall
    reach = Reach([float(c.end) if c.number in live and c.anchors else -1.0 for c in found])
    for number in sorted(live):
        inner = found[number - 1]
        if all(_strength(a) == "weak" for a in inner.listed()):
            at = reach.first_above(float(inner.end), bisect_left(starts, inner.start))
            if at is not None:
                _absorb(found[at], inner)
                live.discard(number)
                reach.put(number - 1, -1.0)
    return [c for c in found if c.number in live]


def group_day(events: list[dict], config: EngineConfig) -> list[tuple[int | None, int | None]]:
    """(activity, context; null: in none) for each event of one day, in order."""
    acts = activities(events, config)
    if len(acts) == 1:  # the one context of a day that has one activity
        own, kept = set(acts[0].events), len(acts[0].events) >= config.least_events
        return [(1, 1 if kept else None) if i in own else (None, None) for i in range(len(events))]
    kept = [c for c in contexts(acts, config) if len(c.events) >= config.least_events]
    activity = {i: a.number for a in acts for i in a.events}
    context = {i: c.number for c in kept for i in c.events}
    return [(activity.get(i), context.get(i)) for i in range(len(events))]


def app_name(events: DataFrame) -> F.Column:
    """The name under which an event's application counts: by source where that says more, else by the application's id, else as it is displayed."""
    none = F.lit(None).cast("string")
    display = F.col("app_display") if "app_display" in events.columns else none
    app = F.nullif(F.col("app"), F.lit("")) if "app" in events.columns else none
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in APP_NAMES.items() for x in pair)), app)
    name = F.coalesce(F.when(app.isNotNull(), known), display, app, F.lit("System"))
    name = F.when(F.col("source") == "agent", F.coalesce(display, F.lit(AGENT_NAME))).otherwise(name)
    for source, fixed in NAMES_BY_SOURCE.items():
        name = F.when(F.col("source") == source, F.lit(fixed)).otherwise(name)
    return name


def assignments(events: DataFrame, config: EngineConfig = EngineConfig(), anchors: DataFrame | None = None) -> DataFrame:
    """session_id, work_day, ord, activity, context for every event. Hard boundaries have neither; events of too small contexts have no context.

    Days come sorted in Arrow batches of many days each; the one that is open is held, whichever batches it lies in. anchors: all_anchors(events), if they are at hand."""
    anchors = all_anchors(events) if anchors is None else anchors
    # both sides move by days alone, so that rows stay where they are for the join by events and the fold by days
    listed = anchors.repartition(*KEYS).groupBy(*KEYS, "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "type", "norm", "confidence"))), lambda a: F.struct(a["type"].alias("type"), a["norm"].alias("norm"), a["confidence"].cast("double").alias("c"))).alias("anchors"))
    moved = events.withColumn("app_name", app_name(events)).select(*KEYS, "ord", "ts_ms", "end_ms", "type", "app_name").repartition(*KEYS)
    frame = moved.join(listed, [*KEYS, "ord"], "left").select(*moved.columns, "anchors")
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    schema = f"session_id {kinds['session_id']}, work_day {kinds['work_day']}, ord {kinds['ord']}, activity long, context long"

    def fold(batches):
        for b, days in _whole_days(batches):
            events, found = _rows(b), []
            for begin, end in zip(days, days[1:]):
                found += group_day(events[begin:end], config)
            activity, context = zip(*found)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(activity, pa.int64()), pa.array(context, pa.int64())], names=["session_id", "work_day", "ord", "activity", "context"])

    return frame.repartition(*KEYS).sortWithinPartitions(*KEYS, "ts_ms", "ord").mapInArrow(fold, schema)


def _begins(b: pa.RecordBatch) -> list[int]:
    """Where rows begin whose first two columns aren't those of the row before."""
    new = np.zeros(max(0, b.num_rows - 1), bool)
    for column in b.columns[:2]:
        x, y = column.slice(0, len(new)), column.slice(1)
        new |= pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False)
        new |= x.is_null().to_numpy(zero_copy_only=False) != y.is_null().to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(new) + 1).tolist()]


def _whole_days(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """The rows in batches of whole days, and where these begin and end. The day that is open is held."""
    held: list[pa.RecordBatch] = []
    closed = lambda: (b := pa.concat_batches(held), [*_begins(b), b.num_rows])
    for b in batches:
        if not b.num_rows:
            continue
        if held and len(_begins(pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), b.slice(0, 1)]))) > 1:
            yield closed()
            held = []
        if last := _begins(b)[-1]:
            held.append(b.slice(0, last))
            yield closed()
            held = []
        held.append(b.slice(last))
    if held:
        yield closed()


def _rows(b: pa.RecordBatch) -> list[dict]:
    """Events as the fold takes them, of the columns ts_ms, end_ms, type, app_name and anchors. Equal anchors are one tuple."""
    start, kind, app = b.column(3), b.column(5).to_pylist(), b.column(6).to_pylist()
    lengths, flat = pc.fill_null(pc.list_value_length(b.column(7)), 0).to_pylist(), b.column(7).flatten()
    one: dict[Anchor, Anchor] = {}
    every = [one.setdefault(a, a) for a in zip(*(flat.field(name).to_pylist() for name in ("type", "norm", "c")))]
    at, out = 0, []
    for t, e, k, a, n in zip(start.to_pylist(), pc.coalesce(b.column(4), start).to_pylist(), kind, app, lengths):
        out.append({"ts": t, "end": e, "type": k, "app": a, "anchors": every[at : at + n]})
        at += n
    return out


def all_anchors(events: DataFrame) -> DataFrame:
    return A.with_keywords(A.event_anchors(events), events)


def contexts_frame(events: DataFrame, assigned: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """anchors: all_anchors(events), if they are at hand. Both are read several times: stage() what is not a table yet.

    One row a context: session_id, work_day, context, start, end, n_events, active_ms, label, fallback, repository, branch, project, issue, confidence, key, ord, tz."""
    on = [*KEYS, "ord"]
    # events, assignments and anchors move by days alone: joins by events, groups by contexts and their joins find the rows of a day in one place
    mine = assigned.where(F.col("context").isNotNull()).repartition(*KEYS)
    rows = events.withColumn("app_name", app_name(events)).select(*on, "ts_ms", "end_ms", "tz", "app_name").repartition(*KEYS).join(mine, on)
    by = [*KEYS, "context"]
    end = F.coalesce("end_ms", "ts_ms")
    base = rows.groupBy(*by).agg(
        F.min("ts_ms").alias("start"), F.max(end).alias("end"), F.count("*").alias("n_events"), F.first("tz").alias("tz"),
        F.min_by("app_name", F.struct("ts_ms", "ord")).alias("first_app"), A.distinct(F.col("app_name")).alias("apps"),
    )
    spans = rows.groupBy(*by, "activity").agg(F.min("ts_ms").alias("start"), F.max(end).alias("end"))
    active = covered_ms(spans, by).withColumnRenamed("covered_ms", "active_ms")
    anchors = all_anchors(events) if anchors is None else anchors
    held = anchors.repartition(*KEYS).join(mine, on)
    best = lambda kind: F.max_by(F.when(F.col("type") == kind, F.col("value")), F.when(F.col("type") == kind, F.struct(F.col("confidence"), -F.col("ord"), -F.col("rank")))).alias(kind)
    named = held.groupBy(*by).agg(*[best(k) for k in ("issue", "document", "branch", "repository", "project")], A.distinct(F.when(F.col("type").isin(A.STRONG), F.struct("type", "norm"))).alias("strong"))
    topic = subjects_of(events, assigned, anchors)
    out = base.join(active, by).join(named, by, "left").join(topic, by, "left")
    subject = pretty(F.coalesce("topic", "branch", "document"))
    label = F.when(F.col("issue").isNotNull() & subject.isNotNull(), F.concat(subject, F.lit(" ("), F.col("issue"), F.lit(")"))).otherwise(F.coalesce("issue", subject))
    out = out.withColumn("_label", label).withColumn("fallback", F.col("_label").isNull()).withColumn("label", F.coalesce("_label", "first_app"))
    confidence = F.least(F.lit(1.0), 0.3 + 0.25 * F.least(F.coalesce("strong", F.lit(0)), F.lit(2)) + 0.1 * F.least("apps", F.lit(4)))
    key = F.lower(F.concat(F.when(F.col("fallback"), F.lit("app:")).otherwise(F.lit("")), F.col("label")))
    out = out.withColumns({"confidence": confidence, "key": key, "ord": F.col("context"), "project": F.when(~F.col("project").eqNullSafe(F.col("repository")), F.col("project"))})
    return out.select(*by, "start", "end", "n_events", "active_ms", "label", "fallback", "repository", "branch", "project", "issue", "confidence", "key", "ord", "tz")


def subjects_of(events: DataFrame, assigned: DataFrame, anchors: DataFrame) -> DataFrame:
    """KEYS, context, topic: the subject with the largest share of the context's events times its confidence."""
    mine = assigned.where(F.col("context").isNotNull()).repartition(*KEYS)
    size = mine.groupBy(*KEYS, "context").agg(F.count("*").alias("size"))
    subjects = A.subject_anchors(events, anchors).select(*KEYS, "norm", "value", "confidence", F.explode("seen").alias("at")).select("*", "at.ord")
    hits = subjects.groupBy(*KEYS, "ord", "norm", "value", "confidence").agg(F.min("at").alias("at")).join(mine, [*KEYS, "ord"])
    counted = hits.groupBy(*KEYS, "context", "norm").agg(F.count("*").alias("n"), F.first("confidence").alias("confidence"), F.first("value").alias("value"), F.min("at").alias("seen"))
    scored = counted.join(size, [*KEYS, "context"]).withColumn("score", F.col("n") / F.col("size") * F.col("confidence"))
    first = F.row_number().over(Window.partitionBy(*KEYS, "context").orderBy(F.desc("score"), "seen")) == 1
    return scored.withColumn("_f", first).where("_f").select(*KEYS, "context", F.col("value").alias("topic"))


def with_config(**changes) -> EngineConfig:
    return replace(EngineConfig(), **changes)


def label_activities(events: DataFrame, assigned: DataFrame, anchors: DataFrame) -> DataFrame:
    """KEYS, activity, label: the first strong, else medium, else keyword anchor's value and the first application; the application alone without any."""
    on = [*KEYS, "ord"]
    acts = events.withColumn("app_name", app_name(events)).join(assigned.where(F.col("activity").isNotNull()), on)
    first = acts.groupBy(*KEYS, "activity").agg(F.min_by("app_name", F.struct("ts_ms", "ord")).alias("app_name"))
    tier = F.when(F.col("type").isin(A.STRONG), 0).when(F.col("type").isin(A.MEDIUM), 1).when(F.col("type") == "keyword", 2)
    held = anchors.join(acts.select(*on, "activity", "ts_ms"), on).withColumn("tier", tier).where(F.col("tier").isNotNull())
    named = held.groupBy(*KEYS, "activity").agg(F.min_by("value", F.struct("tier", "ts_ms", "ord", "rank")).alias("value"))
    return first.join(named, [*KEYS, "activity"], "left").select(*KEYS, "activity", F.concat_ws(" — ", "value", "app_name").alias("label"))


def ordered(contexts_: DataFrame) -> DataFrame:
    """contexts with a column place: of each day those of most activity first, older numbers before newer ones."""
    return contexts_.withColumn("place", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("active_ms"), "context")))


def timeline_blocks(events: DataFrame, assigned: DataFrame) -> DataFrame:
    """KEYS, context, block, activity, ords: a context's activities, the newest first, each with its events from new to old."""
    rows = events.join(assigned.where(F.col("context").isNotNull()), [*KEYS, "ord"])
    newest = F.transform(F.sort_array(F.collect_list(F.struct("ts_ms", "ord")), False), lambda x: x["ord"])
    blocks = rows.groupBy(*KEYS, "context", "activity").agg(newest.alias("ords"), F.max(F.struct("ts_ms", "ord")).alias("last"))
    block = F.row_number().over(Window.partitionBy(*KEYS, "context").orderBy(F.desc("last")))
    return blocks.withColumn("block", block).select(*KEYS, "context", "block", "activity", "ords")
