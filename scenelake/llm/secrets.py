"""Secret scans: fixed formats, and formats inferred from the labelled credentials.

Three patterns find credentials whose kind is known. What they find labels
the training strings: per kind, the prefix tree of all distinct ones is folded
into a probabilistic automaton by merging states whose frequencies of ending
and of continuing are compatible (Hoeffding bounds), root first. Spark counts
the tree in rounds: all strings walk the automaton as far as it goes, what
follows is counted some symbols ahead, and the driver merges the nodes that are
frequent among the strings still open. Rarer nodes have no say in a test, but
their strings walk on and come back in a later round, until none has an open
edge. At last all strings are walked once more for the counts of the moves, and
the threshold is the exact quantile of the scores of all held-out ones. Every other
token of a text, and what follows or lies between its ``=`` and ``/``, is then
scored by all automata; it is reported if its likelihood, length included,
falls no further below the mean of its length than that of labelled
credentials, whatever their lengths, and if a credential is a more
likely source of it than the ordinary tokens of the corpus.

Merging forgets how long strings are, so an automaton keeps the ending
probabilities by length beside its states: all labelled values count, and
lengths that none of them has get what Witten and Bell leave for them.

Symbols are character classes, so a key with random characters has a compact
automaton; punctuation stands for itself.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scenelake.llm.common import arrow_pass, materialise, settle

KINDS = ("assign", "access", "hex")
LEARNED = "learned"
OTHER = "other"
LEAST = {"assign": 6, "access": 20, "hex": 24}

NODES = 1 << 12  # a node of a round's tree counts that has at least one in so many of the strings still open
AHEAD = 16  # symbols by which a round looks ahead
CANDIDATE = min(LEAST.values())  # characters of a token that is scored
BINS = 1024  # of the scores among which a quantile is looked for
OCTAVES = 32
KNOWN = 1 << 16  # verdicts on tokens that a task remembers
ALPHA = 0.05  # of the compatibility test
LOWEST = 0.02  # share of the labelled credentials that may score below the threshold

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# Maximal runs, so the shortest length can be part of the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % CANDIDATE)
_PIECE = re.compile(r"[A-Za-z0-9+_.-]{%d,}" % CANDIDATE)
_SEPARATOR = re.compile("[=/]")
_HINTS = ("passw", "secret", "token", "apikey", "api_key")

_CLASSES = ({c: "0" for c in "0123456789"} | {c: "a" for c in "abcdef"} | {c: "z" for c in "ghijklmnopqrstuvwxyz"}
            | {c: "A" for c in "ABCDEF"} | {c: "Z" for c in "GHIJKLMNOPQRSTUVWXYZ"})
_CLASS_TABLE = str.maketrans(_CLASSES)
_END = "$"  # closes a class string


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, credential) in code points, by start and kind."""
    found = []
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


class Lengths:
    """Log probability of every length, from counts of labelled ones."""

    def __init__(self, counts: dict[int, int]):
        self.counts, self.total, self.kinds = counts, sum(counts.values()), len(counts)
        self.octaves = Counter(n.bit_length() for n in counts)

    def log(self, n: int) -> float:
        octave = n.bit_length()
        other = (self.octaves[octave] + 1) / (self.kinds + OCTAVES) / (1 << max(0, octave - 1))
        return math.log((self.counts.get(n, 0) + self.kinds * other) / (self.total + self.kinds))


@dataclass
class Ordinary:
    """Tokens that are no credentials: moves between neighbouring symbols, lengths, and number of distinct tokens."""

    moves: dict[str, int]
    lengths: dict[int, int]
    distinct: int

    def fields(self) -> tuple:
        return self.moves, self.lengths, self.distinct

    def __post_init__(self):
        self.length = Lengths(self.lengths)
        self.after = Counter()
        for pair, n in self.moves.items():
            self.after[pair[0]] += n
        self.logs: dict[str, float] = {}

    def _move(self, pair: str) -> float:
        if pair not in self.logs:
            self.logs[pair] = math.log((self.moves.get(pair, 0) + 1) / (self.after[pair[0]] + SYMBOLS))
        return self.logs[pair]

    def likelihood(self, symbols: str) -> float:
        line = " " + symbols
        return sum(self._move(line[i:i + 2]) for i in range(len(symbols))) + self.length.log(len(symbols))


SYMBOLS = len(set(_CLASSES.values())) + len("+/_.=-")


@dataclass
class Automaton:
    """States with counts: ``arrivals``, ``endings`` and ``moves`` (symbol to (state, count)); counts of ``lengths``."""

    arrivals: list[int]
    endings: list[int]
    moves: list[dict[str, tuple[int, int]]]
    lengths: dict[int, int]
    threshold: float = 0.0
    usual: tuple | None = None  # fields of the model of ordinary tokens

    def fields(self) -> tuple:
        return self.arrivals, self.endings, self.moves, self.lengths, self.threshold, self.usual

    def __post_init__(self):
        self.length, self.other = Lengths(self.lengths), None
        self.logs = [{x: (state, math.log(n / sum(m for _, m in moves.values()))) for x, (state, n) in moves.items()}
                     for moves in self.moves]

        # Means of the log probability of a move and of a length.
        steps = [(n, log) for moves, logs in zip(self.moves, self.logs) for (_, n), (_, log) in zip(moves.values(), logs.values())]
        self.mean = sum(n * log for n, log in steps) / max(1, sum(n for n, _ in steps))
        self.mean_length = sum(n * self.length.log(size) for size, n in self.lengths.items()) / max(1, self.length.total)

    def format(self, symbols: str) -> float:
        """Log probability of the moves; a string is not finite that has one the automaton has not."""
        state, total = 0, 0.0
        for symbol in symbols:
            step = self.logs[state].get(symbol)
            if step is None:
                return -math.inf
            state, log = step
            total += log
        return total

    def suffixes(self, symbols: str, starts: list[int]) -> dict[int, float]:
        """``format`` of the suffix at each of ``starts``, in one pass from the end."""
        wanted, found, after = set(starts), {}, [0.0] * len(self.moves)
        for i in range(len(symbols) - 1, -1, -1):
            steps = [moves.get(symbols[i]) for moves in self.logs]
            after = [-math.inf if step is None else step[1] + after[step[0]] for step in steps]
            if i in wanted:
                found[i] = after[0]
            if max(after) == -math.inf:
                break
        return found

    def likelihood(self, value: str) -> float:
        """Distance of the log probability of ``value`` from its mean, in units that grow with the root of the length, as chance does."""
        return self._distance(self.format(value.translate(_CLASS_TABLE)), len(value))

    def _distance(self, moves: float, n: int) -> float:
        return (moves - n * self.mean + self.length.log(n) - self.mean_length) / math.sqrt(n)

    def judge(self, moves: float, symbols: str) -> bool:
        """Whether ``symbols`` is a credential; ``moves`` is the log probability of its moves."""
        if moves == -math.inf:
            return False
        n = len(symbols)
        if self._distance(moves, n) < self.threshold:
            return False
        if self.usual is None:
            return True
        self.other = self.other or Ordinary(*self.usual)
        here = moves + self.length.log(n) + math.log(self.length.total)
        return here >= self.other.likelihood(symbols) + math.log(self.other.distinct)

    def accepts(self, value: str) -> bool:
        symbols = value.translate(_CLASS_TABLE)
        return self.judge(self.format(symbols), symbols)


def _line(value: str) -> str:
    """A credential as classes, with its end."""
    return value.translate(_CLASS_TABLE) + _END


def _walk(line: str, moves: list[dict[str, int]]):
    """(state, symbol) of each move; the last one has no successor if the edge is open."""
    state = 0
    for symbol in line:
        yield state, symbol
        state = moves[state].get(symbol)
        if state is None:
            return


def _opened(line: str, moves: list[dict[str, int]]) -> tuple[int, str] | None:
    """State where ``line`` leaves the automaton and what follows; None if it stays inside."""
    at = state = 0
    symbol = _END
    for at, (state, symbol) in enumerate(_walk(line, moves)):
        pass
    return None if symbol == _END else (state, line[at:])


class _Tree:
    """Settled states, and the counted part of the prefix tree behind their open edges; nodes are merged in place."""

    def __init__(self):
        self.arrivals, self.counts, self.children, self.settled = [0], [{}], [{}], [0]

    def moves(self) -> list[dict[str, int]]:
        place = {s: i for i, s in enumerate(self.settled)}
        return [{x: place[c] for x, c in self.children[s].items()} for s in self.settled]

    def hang(self, state: int, nodes: dict[str, dict[str, int]]) -> None:
        """Hang what was counted behind a state's open edges: per prefix the numbers of the symbols that follow."""
        place = {"": self.settled[state]}
        for prefix in sorted(nodes, key=lambda p: (len(p), p)):
            node = place[prefix]
            self.counts[node] |= nodes[prefix]
            for symbol, n in sorted(nodes[prefix].items()):
                if symbol != _END:
                    place[prefix + symbol] = self.children[node][symbol] = len(self.arrivals)
                    self.arrivals.append(n)
                    self.counts.append({})
                    self.children.append({})

    @staticmethod
    def _differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) > bound

    def compatible(self, a: int, b: int) -> bool:
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            n1, n2 = sum(self.counts[a].values()), sum(self.counts[b].values())
            if not n1 or not n2:  # too rare to be counted
                continue
            for symbol in self.counts[a].keys() | self.counts[b].keys():
                if self._differ(self.counts[a].get(symbol, 0), n1, self.counts[b].get(symbol, 0), n2):
                    return False
                if symbol in self.children[a] and symbol in self.children[b]:
                    waiting.append((self.children[a][symbol], self.children[b][symbol]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the subtree of ``b`` to ``a``; ``b`` is a tree still, ``a`` may have loops."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            self.arrivals[a] += self.arrivals[b]
            for symbol, n in self.counts[b].items():
                self.counts[a][symbol] = self.counts[a].get(symbol, 0) + n
            for symbol, child in self.children[b].items():
                if symbol in self.children[a]:
                    waiting.append((self.children[a][symbol], child))
                else:
                    self.children[a][symbol] = child

    def merge(self) -> None:
        """Settle or merge all nodes behind open edges; those that are not counted yet stay open for another round.

        A single string differs from nothing, so it is merged without a look at what follows.
        """
        while True:
            known = set(self.settled)
            open_edges = [(s, x) for s in self.settled for x in sorted(self.children[s]) if self.children[s][x] not in known]
            ready = [(s, x) for s, x in open_edges if self.counts[self.children[s][x]] or self.arrivals[self.children[s][x]] < 2]
            if not ready:
                break
            parent, symbol = min(ready, key=lambda e: (-self.arrivals[self.children[e[0]][e[1]]], e))
            node = self.children[parent][symbol]
            home = next((s for s in self.settled if self.compatible(s, node)), None)
            if home is None:
                self.settled.append(node)
            else:
                self.children[parent][symbol] = home
                self.fold(home, node)
        for s, x in open_edges:
            del self.children[s][x]


def _floor(opened: int) -> int:
    """Strings that a node needs to be counted; a heaviest edge always has them, so every round closes one."""
    return max(2, opened // NODES)


def _automaton(moves: list[dict[str, int]], counts: dict[tuple[int, str], int], lengths: dict[int, int]) -> Automaton:
    """Automaton with the counts of the moves of all strings."""
    steps = [{x: (after, counts[s, x]) for x, after in edges.items() if counts.get((s, x))} for s, edges in enumerate(moves)]
    endings = [counts.get((s, _END), 0) for s in range(len(moves))]
    return Automaton([n + sum(m for _, m in edges.values()) for n, edges in zip(endings, steps)], endings, steps, lengths)


def infer(values: list[str], lengths: dict[int, int]) -> Automaton | None:
    """Automaton of the class strings of a list of ``values``; None without values."""
    tree, lines = _Tree(), [_line(v) for v in values]
    while opened := [o for o in (_opened(line, tree.moves()) for line in lines) if o]:
        nodes: dict[tuple[int, str], Counter] = {}
        for state, rest in opened:
            for i, symbol in enumerate(rest[:AHEAD]):
                nodes.setdefault((state, rest[:i]), Counter())[symbol] += 1
        _hang(tree, [(s, p, c) for (s, p), c in nodes.items() if c.total() >= _floor(len(opened)) or not p])
    moves = tree.moves()
    return _automaton(moves, Counter(step for line in lines for step in _walk(line, moves)), lengths) if values else None


def _hang(tree: _Tree, found) -> None:
    """A round of merging from (state, prefix, numbers of the symbols that follow)."""
    nodes: dict[int, dict] = {}
    for state, prefix, counts in found:
        nodes.setdefault(state, {})[prefix] = dict(counts)
    for state in sorted(nodes):
        tree.hang(state, nodes[state])
    tree.merge()


def fit(labelled: dict[str, list[str]]) -> list[Automaton]:
    """One automaton per kind with values, from lists; a fifth of the values sets the threshold. ``train`` is its spread form."""
    found = []
    for kind in KINDS:
        values = labelled.get(kind, [])
        held = {v for v in values if hashlib.sha256(v.encode()).digest()[0] % 5 == 0}
        automaton = infer([v for v in values if v not in held], dict(Counter(map(len, values))))
        if automaton is None:
            continue
        scores = sorted(s for s in (automaton.likelihood(v) for v in held or values) if s > -math.inf)
        if scores:
            automaton.threshold = scores[int(LOWEST * len(scores))]
            found.append(automaton)
    return found


def train(docs: DataFrame) -> list[Automaton]:
    """Automata from all distinct credentials of the base patterns, each with the model of all other distinct tokens."""

    def run(batches):
        for batch in batches:
            found, other = set(), set()
            for text in batch.column(0).to_pylist():
                base = base_spans(text) if text else []
                if not base:
                    other.update(_TOKEN.findall(text or ""))
                    continue
                found |= {(KINDS[k], value) for _, k, _, value in base}
                free = _free([(start, end) for start, _, end, _ in base])
                other.update(m[0] for m in _TOKEN.finditer(text) if free(m.start(), m.end()))
            kinds = [k for k, _ in found] + [OTHER] * len(other)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([*(v for _, v in found), *other], pa.string())],
                                             ["kind", "value"])

    values = settle(arrow_pass(docs.select("text"), run, "kind string, value string").distinct())
    lengths: dict[str, dict[int, int]] = {}
    for kind, size, n in values.groupBy("kind", F.length("value")).count().collect():
        lengths.setdefault(kind, {})[size] = n
    held = F.conv(F.substring(F.sha2("value", 256), 1, 2), 16, 10).cast("int") % 5 == 0
    labelled = materialise(values.where(F.col("kind") != OTHER).select("kind", "value", held.alias("held")))
    usual = _ordinary(values.where(F.col("kind") == OTHER).select("value"), lengths.pop(OTHER, {}))
    automata = _thresholds(labelled, _inferred(labelled.where("not held").select("kind", "value"), lengths))
    for automaton in automata:
        automaton.usual = usual and usual.fields()
    return automata


def _ordinary(tokens: DataFrame, lengths: dict[int, int]) -> Ordinary | None:
    """Model of different tokens with the given counts of lengths; None without any."""
    if not lengths:
        return None

    def run(batches):
        for batch in batches:
            line = " ".join(["", *batch.column(0).to_pylist()]).translate(_CLASS_TABLE).encode()
            symbols = np.frombuffer(line, dtype=np.uint8).astype(np.int64)
            counts = np.bincount((symbols[:-1] << 8) + symbols[1:], minlength=1 << 16)
            pairs = np.flatnonzero(counts)
            pairs = pairs[pairs & 255 != ord(" ")]
            yield pa.RecordBatch.from_arrays([pa.array([chr(p >> 8) + chr(p & 255) for p in pairs.tolist()], pa.string()),
                                              pa.array(counts[pairs])], ["pair", "n"])

    moves = arrow_pass(tokens, run, "pair string, n long").groupBy("pair").agg(F.sum("n")).collect()
    return Ordinary(dict(sorted(map(tuple, moves))), lengths, sum(lengths.values()))


def _inferred(values: DataFrame, lengths: dict[str, dict[int, int]]) -> dict[str, Automaton]:
    """Automaton of each kind of ``values`` (kind, value)."""
    trees: dict[str, _Tree] = {kind: _Tree() for kind in KINDS}

    def walked(names, schema, step):
        """Rows of ``step(line, moves)`` for every value."""
        moves = {kind: tree.moves() for kind, tree in trees.items()}

        def run(batches):
            for batch in batches:
                found = Counter((kind, *row) for kind, value in zip(*(c.to_pylist() for c in batch.columns))
                                for row in step(_line(value), moves[kind]))
                rows = [*zip(*((*row, n) for row, n in found.items()))] or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int32(), pa.string(), pa.int64()))],
                                                 names)

        return arrow_pass(values, run, schema)

    while True:
        opened = materialise(walked(["kind", "state", "rest", "n"], "kind string, state int, rest string, n long",
                                    lambda line, moves: filter(None, [_opened(line, moves)])))
        floors = {kind: _floor(n) for kind, n in opened.groupBy("kind").agg(F.sum("n")).collect()}
        if not floors:
            break
        ahead = opened.select("kind", "state", "rest", "n", F.explode(F.expr(f"sequence(0, least(length(rest), {AHEAD}) - 1)")).alias("at"))
        follow = ahead.groupBy("kind", "state", F.expr("substring(rest, 1, at)").alias("prefix"),
                               F.expr("substring(rest, at + 1, 1)").alias("symbol")).agg(F.sum("n").alias("n"))
        floor = F.element_at(F.create_map(*[F.lit(x) for item in floors.items() for x in item]), F.col("kind"))
        nodes = follow.groupBy("kind", "state", "prefix").agg(
            F.sum("n").alias("total"), F.collect_list(F.struct("symbol", "n")).alias("counts")).where((F.col("total") >= floor) | (F.col("prefix") == ""))
        found: dict[str, list] = {}
        for kind, state, prefix, _, counts in nodes.collect():  # some NODES * AHEAD of a kind at most
            found.setdefault(kind, []).append((state, prefix, counts))
        for kind in found:
            _hang(trees[kind], found[kind])

    steps: dict[str, dict] = {}
    moved = walked(["kind", "state", "symbol", "n"], "kind string, state int, symbol string, n long", _walk)
    for kind, state, symbol, n in moved.groupBy("kind", "state", "symbol").agg(F.sum("n")).collect():
        steps.setdefault(kind, {})[state, symbol] = n
    return {kind: _automaton(trees[kind].moves(), steps[kind], lengths[kind]) for kind in KINDS if kind in steps}


def _thresholds(labelled: DataFrame, automata: dict[str, Automaton]) -> list[Automaton]:
    """The automata with the quantile ``LOWEST`` of the scores of all held-out values of their kind, of all values if none is held."""
    if not automata:
        return []
    fields = {kind: automaton.fields() for kind, automaton in automata.items()}

    def run(batches):
        learned = {kind: Automaton(*f) for kind, f in fields.items()}
        for batch in batches:
            rows = [(k, learned[k].likelihood(v)) for k, v in zip(*(c.to_pylist() for c in batch.columns))]
            rows = [(k, x) for k, x in rows if x > -math.inf]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.float64())],
                                             ["kind", "score"])

    some = [kind for kind, in labelled.where("held").select("kind").distinct().collect()]
    asked = labelled.where((F.col("held") | ~F.col("kind").isin(some)) & F.col("kind").isin(list(automata)))
    scores = materialise(arrow_pass(asked.select("kind", "value"), run, "kind string, score double"))
    found = []
    for kind in KINDS:
        own = scores.where(F.col("kind") == kind).select("score")
        n, low, high = own.agg(F.count("*"), F.min("score"), F.max("score")).collect()[0]
        if not n:
            continue
        rank = int(LOWEST * n)
        while low < high:  # the bin that holds the rank, ever finer
            share = (F.col("score") - low) / (high - low) * BINS
            bins = own.where(F.col("score").between(low, high)).groupBy(F.floor(share).alias("bin")).agg(
                F.count("*"), F.min("score"), F.max("score")).orderBy("bin").collect()
            for _, n, low, high in bins:
                if rank < n:
                    break
                rank -= n
        automata[kind].threshold = low
        found.append(automata[kind])
    return found


def _free(taken: list[tuple[int, int]]):
    """Test whether a span touches none of ``taken``, which are sorted by start."""
    starts, ends, last = [s for s, _ in taken], [], 0
    for _, end in taken:
        last = max(last, end)
        ends.append(last)

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return not before or ends[before - 1] <= start

    return free


def _accepted(value: str, automata: list[Automaton]) -> bool:
    return len(value) >= CANDIDATE and any(a.accepts(value) for a in automata)


def credentials(token: str, automata: list[Automaton]) -> list[tuple[int, int]]:
    """Spans of ``token``: all of it, else what follows a separator up to the end or to the next separator."""
    if len(token) < CANDIDATE:
        return []
    symbols = token.translate(_CLASS_TABLE)
    if any(a.judge(a.format(symbols), symbols) for a in automata):
        return [(0, len(token))]
    cuts = [m.start() for m in _SEPARATOR.finditer(token)]
    if not cuts:
        return []
    starts = [c + 1 for c in cuts if c + 1 + CANDIDATE <= len(token)]
    tails = [a.suffixes(symbols, starts) for a in automata]
    found = []
    for start, end in zip([0, *[c + 1 for c in cuts]], [*cuts, len(token)]):
        if start and any(start in t and a.judge(t[start], symbols[start:]) for a, t in zip(automata, tails)):
            return [*found, (start, len(token))]
        value = token[start:end].rstrip(".")
        if _accepted(value, automata):
            found.append((start, start + len(value)))
    return found


def all_spans(text: str, automata: list[Automaton], find=None) -> tuple[
        list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, all spans) as (start, kind, end); learned ones never touch a base span.

    ``find`` may stand for ``credentials`` with a memory.
    """
    base = [(start, KINDS[k], end) for start, k, end, _ in base_spans(text)]
    free = _free([(start, end) for start, _, end in base])
    find = find or (lambda value: credentials(value, automata))
    more = []
    for m in _TOKEN.finditer(text) if automata else ():
        start = m.start()
        if free(start, m.end()):
            more += [(start + a, LEARNED, start + b) for a, b in find(m[0].rstrip("."))]
        else:  # what lies between base spans and separators
            for piece in _PIECE.finditer(text, start, m.end()):
                value = piece[0].rstrip(".")
                if free(piece.start(), piece.start() + len(value)) and _accepted(value, automata):
                    more.append((piece.start(), LEARNED, piece.start() + len(value)))
    rank = {kind: i for i, kind in enumerate((*KINDS, LEARNED))}
    return base, sorted(base + more, key=lambda s: (s[0], rank[s[1]]))


def scan(docs: DataFrame, automata: list[Automaton]) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans (arrays of start, kind, end in code points).

    Null and empty texts have no spans; repeated rows get equal results;
    without labelled credentials only the base patterns report. Further columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast([a.fields() for a in automata])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches):
        learned = [Automaton(*fields) for fields in shared.value]
        find = lru_cache(KNOWN)(lambda value: credentials(value, learned))
        for batch in batches:
            found = [all_spans(text, learned, find) if text else ([], []) for text in batch.column(1).to_pylist()]
            columns = [pa.array([[dict(zip(("start", "kind", "end"), s)) for s in spans[i]] for spans in found], kind)
                       for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "spans"])

    row = "array<struct<start: long, kind: string, end: long>>"
    return arrow_pass(docs.select("doc_id", "text"), run,
                      f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {row}, spans {row}")
