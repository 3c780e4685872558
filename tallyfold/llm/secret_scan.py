"""Secret scan: fixed patterns, and formats learned from the credentials that they find.

The fixed patterns label credentials in all documents, and all distinct values of each kind are learned from. From them a
prefix tree is counted: letters and digits lead one way, and a mark a way of
its own where it is common at that place, so that the counts along a format do not thin out and its length and
marks are kept. Spark counts all places up to the next common mark in one job; what the driver holds is the tree, whose size
does not grow with the values: past ``DEEP`` characters a state leads to itself. States with enough counts are merged where a Hoeffding test finds the frequencies of their next character
classes and ends compatible, and those of all states after them; the result is a probabilistic automaton of the format.

Every run of ``MIN_RUN`` characters or more is then scored, less what a fixed pattern covers: the log likelihood under
an automaton, against the better of two ordinary models, of runs with letters and digits and of other runs, counted over all distinct
runs. Runs with letters and digits whose outline is rare are left out of those models, since they may be credentials. An automaton's
threshold lies above every ordinary run, and at ``MIN_GAIN`` at least. A run that stays below is scored again in its parts
between equals signs. What is above is reported as kind ``format`` beside the fixed ones, which always stay.

Spans are code points, end exclusive. Null and empty texts have no spans. Without labelled
credentials nothing is learned and only the fixed patterns report. No order of rows matters: values are only counted.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.session import settle

from .batches import SLICE_BYTES, bounded_batches, frugal, slices, texts

#: Significance of the merge test and counts it needs.
ALPHA, LEAST = 0.05, 20
#: Shares of the values at a place, and of all values, from which a mark leads a way of its own there.
COMMON, COMMON_OF_ALL = 0.05, 0.01
#: Places of a value that have states of their own.
DEEP = 256
#: Least log-likelihood gain over ordinary text, and of how much a threshold lies above ordinary runs.
MIN_GAIN, MARGIN = 12.0, 1.0
#: Runs with letters and digits are ordinary if so many, and such a share, of them have one outline; random tokens have outlines of their own.
REPEATED, REPEATED_SHARE = 3, 3 / 4_000
MIN_RUN = 8
#: Values up to this length, and so many of them, are scored and sent once in a task.
CACHED_LENGTH, CACHED = 64, 1 << 16

KINDS = ("assign", "access", "hex")
# The patterns and least lengths of the three base kinds.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_RUN)
# Between equals signs; those at the end are padding.
PART = re.compile(r"[^=]+(?:=+(?![^=]))?")
STEMS = ("passw", "secret", "token", "api")


def base_spans(text: str, runs: list[re.Match] | None = None) -> list[tuple[str, int, int, str]]:
    """Kind, start, end and secret value of the fixed patterns, by start, then in the order of ``KINDS``."""
    found = []
    lower = text.lower()
    if any(s in lower for s in STEMS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                found.append(("assign", m.start(), m.end(), m[2]))
    # The other two kinds are made of letters of a run, and longer than the shortest runs.
    for run in RUN.finditer(text) if runs is None else runs:
        if run.end() - run.start() < ACCESS_LEAST:
            continue
        for m in ACCESS.finditer(text, run.start(), run.end()):
            if len(m[0]) >= ACCESS_LEAST:
                found.append(("access", m.start(), m.end(), m[0]))
        if run.end() - run.start() >= HEX_LEAST:
            for m in HEX.finditer(text, run.start(), run.end()):
                if len(m[0]) >= HEX_LEAST:
                    found.append(("hex", m.start(), m.end(), m[0]))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def classes(value: str) -> str:
    """Letters as their class: hex letters and other letters by case, digits; marks stay."""
    return value.translate(_CLASSES)


_MEMBERS = {"h": "abcdef", "z": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "Z": "GHIJKLMNOPQRSTUVWXYZ", "0": "0123456789"}
_CLASSES = str.maketrans({c: name for name, held in _MEMBERS.items() for c in held})
_SPREAD = {"h": math.log(6), "z": math.log(20), "H": math.log(6), "Z": math.log(20), "0": math.log(10)}


@dataclass
class Automaton:
    """Probabilistic automaton: log probability of each next class, and of ending, by state."""

    moves: list[dict[str, tuple[int, float]]] = field(default_factory=list)
    ends: list[float] = field(default_factory=list)
    #: Where a class leads that was never seen in a state; -1 if the format is over there.
    others: list[int] = field(default_factory=list)
    floor: float = math.log(1e-4)
    #: Gain over ordinary text from which a run is of this format.
    threshold: float = MIN_GAIN

    def log_likelihood(self, shape: str) -> float:
        """Of a run of classes; the letters of a class count as equally likely."""
        at, total = 0, 0.0
        for c in shape:
            move = self.moves[at].get(c) if at >= 0 else None
            at, gain = move if move else (self.others[at] if at >= 0 and self.others else -1, self.floor)
            total += gain - _SPREAD.get(c, 0.0)
        return total + (self.ends[at] if at >= 0 else self.floor)


class Tree:
    """A prefix tree that is counted job by job.

    A trunk is a start depth and the states that one reaches from there on the common way; ``splits`` has by trunk and depth the
    trunks that marks lead to. Counts of a trunk hold up to the first split that is not known yet, so each ``settle`` ends them
    there, and a further count goes on behind it.
    """

    def __init__(self, total: int):
        self.least = max(LEAST, COMMON_OF_ALL * total)
        self.splits: list[dict[int, dict[str, int]]] = [{}]
        #: The depth from which on a trunk's counts are open; none if it is done.
        self.open: dict[int, int] = {0: 0}
        self.counts: dict[tuple[int, int], dict[str, int]] = {}

    def count(self, shape: str, n: int, into: dict) -> None:
        """Adds a value to the open counts, by trunk, depth and class; the end counts as a class."""
        trunk = 0
        for i, c in enumerate(shape):
            depth = i if i < DEEP else DEEP
            if depth >= self.open.get(trunk, _DONE):
                into[trunk, depth, c] += n
            trunk = self.splits[trunk].get(depth, _NONE).get(c, trunk)
        depth = min(len(shape), DEEP)
        if depth >= self.open.get(trunk, _DONE):
            into[trunk, depth, _END] += n

    def settle(self, counted: dict[tuple[int, int, str], int]) -> None:
        """Keeps what holds of the counts of all values, and splits each open trunk at its next common marks."""
        places: defaultdict[tuple[int, int], dict[str, int]] = defaultdict(dict)
        for (trunk, depth, c), n in counted.items():
            places[trunk, depth][c] = n
        opened = {}
        for trunk, depth in self.open.items():
            while (trunk, depth) in places:
                count = self.counts[trunk, depth] = places[trunk, depth]
                held = sum(count.values())
                own = sorted(c for c, n in count.items() if c not in _SPREAD and c != _END and n >= max(self.least, COMMON * held))
                depth += 1
                if own and depth <= DEEP:
                    self.splits[trunk][depth - 1] = {c: len(self.splits) + i for i, c in enumerate(own)}
                    self.splits += [{} for _ in own]
                    opened |= {t: depth for t in (trunk, *self.splits[trunk][depth - 1].values())}
                    break
        self.open = opened

    def states(self):
        """Moves, counts of passes, ends and next classes of each state, root first, and the states that lead to themselves."""
        number = {place: i for i, place in enumerate(sorted(self.counts, key=lambda p: (p[1], p[0])))} or {(0, 0): 0}
        next_state, passed, ended, used, loops = [], [], [], [], set()
        for (trunk, depth), i in number.items():
            count = self.counts.get((trunk, depth), {})
            own = self.splits[trunk].get(depth, {})
            ways = {_ANY: (trunk, depth + 1)} | {c: (to, depth + 1) for c, to in own.items()}
            next_state.append({w: number[p] for w, p in ways.items() if p in number})
            passed.append(sum(count.values()))
            ended.append(count.get(_END, 0))
            used.append(defaultdict(int, {c: n for c, n in count.items() if c != _END}))
            if depth == DEEP:
                loops.add(i)
        return next_state, passed, ended, used, loops


_ANY, _END, _DONE, _NONE = "*", "$", DEEP + 1, {}


def grown(shapes: list[str]) -> Tree:
    """The tree of values at hand."""
    tree = Tree(len(shapes))
    while tree.open:
        counted: defaultdict[tuple[int, int, str], int] = defaultdict(int)
        for shape in shapes:
            tree.count(shape, 1, counted)
        tree.settle(counted)
    return tree


def infer(shapes: list[str] | Tree, alpha: float = ALPHA) -> Automaton:
    """Merges compatible states of the prefix tree of ``shapes``, or of a tree that has been counted, shallow states first."""
    next_state, passed, ended, used, loops = (shapes if isinstance(shapes, Tree) else grown(shapes)).states()
    bound_factor = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(k: int, n: int, l: int, m: int) -> bool:
        return abs(k / n - l / m) > bound_factor * (n**-0.5 + m**-0.5)

    def compatible(a: int, b: int) -> bool:
        stack, seen = [(a, b)], set()
        while stack:
            a, b = pair = stack.pop()
            if a == b or pair in seen or min(passed[a], passed[b]) < LEAST:
                continue
            seen.add(pair)
            if differ(ended[a], passed[a], ended[b], passed[b]):
                return False
            for c in used[a].keys() | used[b].keys():
                if differ(used[a].get(c, 0), passed[a], used[b].get(c, 0), passed[b]):
                    return False
            stack += [(next_state[a][w], next_state[b][w]) for w in next_state[a].keys() & next_state[b].keys()]
        return True

    def fold(into: int, tree: int) -> None:
        """Adds the counts of a subtree to the states that its classes lead to."""
        stack = [(into, tree)]
        while stack:
            a, b = stack.pop()
            passed[a] += passed[b]
            ended[a] += ended[b]
            for c, n in used[b].items():
                used[a][c] += n
            for way, child in next_state[b].items():
                if way in next_state[a]:
                    stack.append((next_state[a][way], child))
                else:
                    next_state[a][way] = child

    # Each entry is a move of a settled state; the state it leads to is settled or merged into one that is.
    settled, known, queue = [0], {0}, [(0, w) for w in sorted(next_state[0])]
    for parent, way in queue:  # grows while it is read
        state = next_state[parent][way]
        if state in known:
            continue
        twin = None
        if passed[state] >= LEAST:
            twin = next((t for t in settled if passed[t] >= LEAST and compatible(t, state)), None)
        if twin is None:
            settled.append(state)
            known.add(state)
            queue += [(state, w) for w in sorted(next_state[state])]
        else:
            next_state[parent][way] = twin
            fold(twin, state)
            # Moves that the merge added to settled states lead to states still to be judged.
            queue += [(t, w) for t in settled for w in sorted(next_state[t]) if next_state[t][w] not in known]
    number = {t: i for i, t in enumerate(settled)}
    out = Automaton()
    for t in settled:
        whole, ways = passed[t] + 1.0, next_state[t]
        if t in loops:
            ways.setdefault(_ANY, t)
        reached = {c: ways.get(c, ways.get(_ANY)) for c in used[t]}
        # However many values there are, nothing is less likely than what was never seen.
        out.moves.append({c: (number[to], max(out.floor, math.log((used[t][c] + 0.1) / whole))) for c, to in reached.items() if to is not None})
        out.ends.append(max(out.floor, math.log((ended[t] + 0.1) / whole)))
        out.others.append(number[ways[_ANY]] if _ANY in ways else -1)
    return out


@dataclass
class Ordinary:
    """Class pairs of ordinary candidates, the model that a format must beat."""

    pairs: dict[str, float]

    def log_likelihood(self, shape: str) -> float:
        known, least = self.pairs, math.log(1e-3)
        total = 0.0
        for a, c in zip("^" + shape, shape + "$"):
            total += known.get(a + c, least) - _SPREAD.get(c, 0.0)
        return total


def count_pairs(shape: str, n: int, into: dict) -> None:
    for a, c in zip("^" + shape, shape + "$"):
        into[a + c] += n


def ordinary(shapes: list[str]) -> Ordinary:
    count: defaultdict[str, int] = defaultdict(int)
    for shape in shapes:
        count_pairs(shape, 1, count)
    return ordinary_of(count)


def ordinary_of(count: dict[str, int]) -> Ordinary:
    """The model of counted class pairs."""
    first: defaultdict[str, int] = defaultdict(int)
    for pair, n in count.items():
        first[pair[0]] += n
    return Ordinary({p: math.log((n + 0.5) / (first[p[0]] + 6.0)) for p, n in count.items()})


def candidates(runs: list[re.Match], base: list) -> Iterator[tuple[int, int]]:
    """Start and end of what the fixed spans (by start) leave of each run, from ``MIN_RUN`` characters on."""
    i = 0
    for run in runs:
        at, end = run.span()
        while i < len(base) and base[i][2] <= at:
            i += 1
        j = i
        while j < len(base) and base[j][1] < end:
            if base[j][1] - at >= MIN_RUN:
                yield at, base[j][1]
            at = max(at, base[j][2])
            j += 1
        if end - at >= MIN_RUN:
            yield at, end


def ordinary_kind(run: str) -> str:
    return "mixed" if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) else "plain"


#: Rows that are sent from Python at a time.
ROWS = 4_000


def _rows(rows: list[tuple], **types: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], list(types))


@frugal
def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind and value of every credential and every ordinary run; short values are not repeated at once."""
    seen: set[tuple[str, str]] = set()
    rows, size = [], 0
    for batch in batches:
        for part in slices(batch):
            for text in texts(part):
                runs = list(RUN.finditer(text))
                spans = base_spans(text, runs)
                found = [(kind, value) for kind, _, _, value in spans]
                for start, end in candidates(runs, spans):
                    found.append((ordinary_kind(text[start:end]), text[start:end]))
                for row in found:
                    if row in seen:
                        continue
                    if len(row[1]) <= CACHED_LENGTH:
                        if len(seen) >= CACHED:
                            seen.clear()
                        seen.add(row)
                    rows.append(row)
                    size += len(row[1])
                    if len(rows) >= ROWS or size >= SLICE_BYTES:
                        yield _rows(rows, kind=pa.string(), value=pa.string())
                        rows, size = [], 0
    if rows:
        yield _rows(rows, kind=pa.string(), value=pa.string())


def _shapes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, int]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("kind", "shape", "n")))


def _pair_counts(shapes: DataFrame) -> dict[str, dict[str, int]]:
    """Counts of class pairs by kind."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = defaultdict(lambda: defaultdict(int))
        for kind, shape, n in _shapes_of(batches):
            count_pairs(shape, n, into[kind])
        rows = [(k, p, n) for k, held in into.items() for p, n in held.items()]
        if rows:
            yield _rows(rows, kind=pa.string(), pair=pa.string(), n=pa.int64())

    out = defaultdict(dict)
    for r in shapes.mapInArrow(count, "kind string, pair string, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect():  # a row for two classes
        out[r.kind][r.pair] = r.n
    return out


def _counted_trees(shapes: DataFrame) -> dict[str, Tree]:
    """The prefix tree of each kind in ``shapes``, counted in as many jobs as common marks follow each other."""
    totals = {r.kind: r.n for r in shapes.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    trees = {k: Tree(totals[k]) for k in KINDS if k in totals}
    while grows := {k: t for k, t in trees.items() if t.open}:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            into = defaultdict(lambda: defaultdict(int))
            for kind, shape, n in _shapes_of(batches):
                if kind in grows:
                    grows[kind].count(shape, n, into[kind])
            rows = [(k, *place, n) for k, held in into.items() for place, n in held.items()]
            for i in range(0, len(rows), ROWS):
                yield _rows(rows[i:i + ROWS], kind=pa.string(), trunk=pa.int32(), depth=pa.int32(), c=pa.string(), n=pa.int64())

        counted = shapes.mapInArrow(count, "kind string, trunk int, depth int, c string, n long")
        found = {k: {} for k in grows}
        for r in counted.groupBy("kind", "trunk", "depth", "c").agg(F.sum("n").alias("n")).collect():  # a row for a place of the tree and a class
            found[r.kind][r.trunk, r.depth, r.c] = r.n
        for k, tree in grows.items():
            tree.settle(found[k])
    return trees


def _highest_gains(shapes: DataFrame, automata: list[Automaton], models: list[Ordinary]) -> dict[int, float]:
    """The most that an ordinary run gains under each automaton."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, float] = {}
        for _, shape, _ in _shapes_of(batches):
            base = max(m.log_likelihood(shape) for m in models)
            for i, a in enumerate(automata):
                most[i] = max(most.get(i, -math.inf), a.log_likelihood(shape) - base)
        if most:
            yield _rows(list(most.items()), i=pa.int32(), gain=pa.float64())

    return {r.i: r.gain for r in shapes.mapInArrow(score, "i int, gain double").groupBy("i").agg(F.max("gain").alias("gain")).collect()}


def outline(shape: Column) -> Column:
    """The shape with no more than three of one class in a row."""
    return F.regexp_replace(shape, r"(.)\1{3,}", "$1$1$1")


def learn_formats(docs: DataFrame) -> tuple[list[Automaton], list[Ordinary]]:
    """Automata of the three kinds with their thresholds, and the ordinary models, from all of ``docs`` (``text``)."""
    values = bounded_batches(docs.select("text")).mapInArrow(_values, "kind string, value string").distinct()
    shape = F.translate("value", "".join(_MEMBERS.values()), "".join(len(held) * name for name, held in _MEMBERS.items()))
    shapes = settle(values.groupBy("kind", shape.alias("shape")).agg(F.count(F.lit(1)).alias("n")), "secret-shapes")
    trees = _counted_trees(shapes.where(F.col("kind").isin(*KINDS)))
    mixed = shapes.where("kind = 'mixed'").withColumn("outline", outline(F.col("shape")))
    total = mixed.agg(F.sum("n")).first()[0] or 0
    common = mixed.groupBy("outline").agg(F.sum("n").alias("n")).where(F.col("n") >= max(REPEATED, REPEATED_SHARE * total))
    # No more outlines than have such a share.
    mixed = mixed.join(F.broadcast(common.select("outline")), "outline", "left_semi").select("kind", "shape", "n")
    runs = mixed.union(shapes.where("kind = 'plain'").select("kind", "shape", "n"))
    pairs = _pair_counts(runs)
    models = [ordinary_of(pairs[k]) for k in ("mixed", "plain") if k in pairs] or [ordinary([])]
    automata = [infer(trees[k]) for k in KINDS if k in trees]
    if automata:
        gains = _highest_gains(runs, automata, models)
        for i, automaton in enumerate(automata):
            automaton.threshold = max(MIN_GAIN, gains.get(i, 0.0) + MARGIN)
    return automata, models


def format_gain(value: str, automata: list[Automaton], plain: list[Ordinary]) -> float:
    """Log-likelihood gain over ordinary text, above the threshold of the automaton that gains most over its own."""
    shape = classes(value)
    return max(a.log_likelihood(shape) - a.threshold for a in automata) - max(o.log_likelihood(shape) for o in plain)


def format_spans(text: str, runs: list[re.Match], base: list, is_format) -> list[tuple[str, int, int, str]]:
    found = []
    for start, end in candidates(runs, base):
        if is_format(text[start:end]):
            found.append(("format", start, end, text[start:end]))
        elif "=" in text[start:end]:
            for m in PART.finditer(text, start, end):
                if len(m[0]) >= MIN_RUN and is_format(m[0]):
                    found.append(("format", m.start(), m.end(), m[0]))
    return found


def judge_of_formats(automata: list[Automaton], plain: list[Ordinary]):
    """Tells whether a value is of a learned format."""
    def judge(value: str) -> bool:
        return format_gain(value, automata, plain) >= 0

    cached = lru_cache(CACHED)(judge)
    return lambda value: (cached if len(value) <= CACHED_LENGTH else judge)(value)


def joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans`` of every document."""
    docs = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    automata, plain = learn_formats(docs)
    names = ["k", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    @frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_format = judge_of_formats(automata, plain)
        order = {k: i for i, k in enumerate((*KINDS, "format"))}
        for batch in batches:
            for part in slices(batch):
                counts, digests, spans = {k: [] for k in KINDS}, [], []
                for text in texts(part):
                    runs = list(RUN.finditer(text))
                    base = base_spans(text, runs)
                    more = format_spans(text, runs, base, is_format) if automata else []
                    for k in KINDS:
                        counts[k].append(sum(s[0] == k for s in base))
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(sorted(base + more, key=lambda s: (s[1], order[s[0]]))))
                yield pa.RecordBatch.from_arrays([
                    part.column("k"), *(pa.array(counts[k], pa.int64()) for k in KINDS),
                    pa.array(digests, pa.string()), pa.array(spans, pa.string())], names)

    kind = dict(docs.dtypes)["k"]
    schema = f"k {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return bounded_batches(docs).mapInArrow(scan, schema).withColumnRenamed("k", key)
