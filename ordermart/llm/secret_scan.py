"""Secret scans: patterns, and formats learnt by grammar inference.

Three fixed patterns find the base spans. What they find is a labelled sample of
credentials; from its prefix tree, states whose futures don't differ significantly
(Hoeffding's bound) are merged into a probabilistic automaton. Every run of
credential letters is then a candidate, and so is every part of it between signs, with
the signs beside it or without. Each is scored by how much likelier the automaton makes
it than the letter pairs of the corpus's ordinary runs do; of candidates that overlap
those are reported whose margins add up to most. What stands beside a base span in the
same run is a candidate too, and so is a part that holds the span.

Null and empty texts have no spans; texts are scanned whole. Repeated rows are
scanned each for itself, and an empty table gives no rows. Without any base span in
the corpus there is nothing to learn from, and only base spans are reported.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermart.llm.common import id_and_text, map_slices, saved, texts

#: The base patterns. Fixed values.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex"]
#: Words without one of which ASSIGN can't match, in lower case.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A candidate has as many letters as the shortest secret that ASSIGN finds.
SHORTEST = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
SIGN = re.compile(r"[+/_.=-]")
#: Runs up to this length are remembered with their spans, so many of them at most.
KNOWN_LETTERS, KNOWN_RUNS = 64, 200_000
#: Letters that a pair may hold besides the run's start and end.
EDGE = "\n"

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [
            (m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6
        ]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def credential(text: str, span: Span) -> str:
    """The letters of a span that the secret itself consists of."""
    found = text[span[0] : span[1]]
    return ASSIGN.match(found)[2] if span[2] == "assign" else found


#: Stands for every letter of a kind's alphabet after the common beginning.
ANY = "any"


class Alphabet:
    """How a kind's credentials are spelt: a common beginning, letter by letter, then
    letters of those that the examples hold, all alike; signs are each their own."""

    def __init__(self, words: list[str]):
        self.start = os.path.commonprefix(words) if len(set(words)) > 1 else ""
        rest = {c for w in words for c in w[len(self.start) :]}
        self.letters = {c for c in rest if c.isalnum()}

    def symbols(self, word: str) -> list[str] | None:
        """A word's symbols, or None where no example has such a letter."""
        n = len(self.start)
        if not word.startswith(self.start):
            return None
        letters = self.letters
        found = [ANY if c in letters else c for c in word[n:]]
        return [*self.start, *found]


@dataclass
class State:
    ends: int = 0
    counts: Counter = field(default_factory=Counter)
    next: dict[str, int] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return self.ends + sum(self.counts.values())


class Automaton:
    """A probabilistic automaton by state merging. `alpha`: the chance of keeping two
    states apart that are the same; larger keeps more apart."""

    def __init__(self, words: list[str], alpha: float = 0.05):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.alphabet = Alphabet(words)
        self.each = -math.log(max(1, len(self.alphabet.letters)))
        self.states: list[State] = [State()]
        for w in words:
            at = 0
            for c in self.alphabet.symbols(w):
                self.states[at].counts[c] += 1
                if c not in self.states[at].next:
                    self.states[at].next[c] = len(self.states)
                    self.states.append(State())
                at = self.states[at].next[c]
            self.states[at].ends += 1
        self.merge_states()

    def differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def alike(self, a: int, b: int) -> bool:
        """Whether no frequency after the two differs significantly. b's part is a tree."""
        todo = [(a, b)]
        while todo:
            x, y = (self.states[i] for i in todo.pop())
            if self.differ(x.ends, x.total or 1, y.ends, y.total or 1):
                return False
            for c in x.counts.keys() | y.counts.keys():
                if self.differ(x.counts[c], x.total, y.counts[c], y.total):
                    return False
                if c in x.next and c in y.next:
                    todo.append((x.next[c], y.next[c]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add b's tree to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = self.states[a], self.states[b]
            x.ends += y.ends
            x.counts.update(y.counts)
            for c, to in y.next.items():
                if c in x.next:
                    todo.append((x.next[c], to))
                else:
                    x.next[c] = to

    def merge_states(self) -> None:
        """Kept states grow from the root: a successor is folded into the first kept
        state that it is like, or else kept itself."""
        kept = [0]
        edge = [(0, c) for c in sorted(self.states[0].next)]
        while edge:
            # the successor that most words reach comes first
            at, c = max(edge, key=lambda e: (self.states[e[0]].counts[e[1]], -e[0], e[1]))
            new = self.states[at].next[c]
            for old in kept:
                if self.alike(old, new):
                    self.states[at].next[c] = old
                    self.fold(old, new)
                    break
            else:
                kept.append(new)
            known = set(kept)
            edge = [
                (k, c)
                for k in kept
                for c, to in sorted(self.states[k].next.items())
                if to not in known
            ]
        place = {k: i for i, k in enumerate(kept)}
        self.states = [
            State(s.ends, s.counts, {c: place[to] for c, to in s.next.items()})
            for s in (self.states[k] for k in kept)
        ]

    def log_likelihood(self, word: str) -> float:
        """Natural logarithm; a step that no example took has minus infinity, an end
        where none ended counts as half an example."""
        symbols = self.alphabet.symbols(word)
        if symbols is None:
            return -math.inf
        at, total = 0, 0.0
        for c in symbols:
            s = self.states[at]
            if c not in s.next:
                return -math.inf
            total += math.log(s.counts[c] / s.total) + (self.each if c == ANY else 0.0)
            at = s.next[c]
        s = self.states[at]
        return total + math.log(max(s.ends, 0.5) / (s.total + 0.5))


class Steps:
    """An automaton's logarithms, made ready to read a run letter by letter. `share`: the
    kind's share of the examples."""

    def __init__(self, share: float, automaton: Automaton):
        self.share = math.log(share)
        self.letters = automaton.alphabet.letters
        self.start = automaton.alphabet.start
        #: letters of a candidate that are counted, to know when it may end
        self.count = max(SHORTEST, len(self.start))
        self.next = [
            {
                c: (math.log(s.counts[c] / s.total) + (automaton.each if c == ANY else 0.0), to)
                for c, to in s.next.items()
            }
            for s in automaton.states
        ]
        self.end = [math.log(max(s.ends, 0.5) / (s.total + 0.5)) for s in automaton.states]
        signs = {c for s in automaton.states for c in s.next if c != ANY}
        spelt = re.escape("".join(sorted(self.letters | signs | set(self.start))))
        #: what any candidate of this kind consists of
        self.spelt = re.compile(f"[{spelt}]{{{SHORTEST},}}")

    def step(self, state: int, read: int, letter: str) -> tuple[float, int] | None:
        """Logarithm and next state of a letter after `read` others, or None."""
        if read < len(self.start):
            return self.next[state].get(letter) if letter == self.start[read] else None
        return self.next[state].get(ANY if letter in self.letters else letter)


@dataclass
class Formats:
    """An automaton for each kind with its share of the examples, and the logarithms of
    letter pairs in ordinary runs."""

    automata: list[tuple[float, Automaton]]
    pairs: dict[str, float]
    unseen: float

    def __post_init__(self):
        self.steps = [Steps(share, a) for share, a in self.automata]
        self.known: dict[float, dict[str, list[tuple[int, int]]]] = {}

    def margin(self, word: str) -> float:
        """Log-likelihood ratio of credential to ordinary run."""
        best = max(
            (math.log(share) + a.log_likelihood(word) for share, a in self.automata),
            default=-math.inf,
        )
        if best == -math.inf:
            return best
        run = EDGE + word + EDGE
        return best - sum(self.pairs.get(run[i : i + 2], self.unseen) for i in range(len(run) - 1))

    def spans(self, run: str, least_margin: float) -> list[tuple[int, int]]:
        """Places in a run of the candidates that are reported."""
        known = self.known.setdefault(least_margin, {})
        found = known.get(run)
        if found is None:
            find = self.parse if SIGN.search(run) else self.whole
            found = find(run, least_margin) if any(s.spelt.search(run) for s in self.steps) else []
            if len(run) <= KNOWN_LETTERS:
                if len(known) >= KNOWN_RUNS:
                    known.clear()
                known[run] = found
        return found

    def whole(self, run: str, least_margin: float) -> list[tuple[int, int]]:
        """The same of a run without signs, which is its only candidate."""
        if not any(s.spelt.fullmatch(run) for s in self.steps):
            return []
        return [(0, len(run))] if self.margin(run) >= least_margin else []

    def parse(
        self, run: str, least_margin: float, base: Sequence[tuple[int, int, float]] = ()
    ) -> list[tuple[int, int]]:
        """The candidates without overlap whose margins above `least_margin` add up to
        most. Of all beginnings that bring an automaton to the same state only the best
        can be part of it, so that the work grows with the run, not its pairs of signs.
        `base`: places of base spans in the run with the margins of their credentials;
        a candidate lies beside such a span or holds it and does better."""
        cuts = {0, len(run)}
        for m in SIGN.finditer(run):
            cuts |= {m.start(), m.end()}
        cuts |= {e for s in base for e in s[:2]}
        for s, e, _ in base:
            cuts -= set(range(s + 1, e))
        # after overlapping base spans are tied, each one ends at a cut
        ends = {e: (s, more) for s, e, more in base}
        best = 0.0  # sum of the run so far
        last: tuple[int, int] | None = None  # and its last candidate
        chosen: dict[int, tuple[int, int] | None] = {}  # the last candidate up to each cut
        sums: dict[int, float] = {}
        # (kind, state, letters read up to the count) -> sum so far, beginning
        paths: dict[tuple[int, int, int], tuple[float, int]] = {}
        for at in range(len(run) + 1):
            if at in cuts:
                if at in ends:
                    start, more = ends[at]
                    before = sums[start] + more
                    if before >= best:
                        best, last = before, chosen[start]
                edge = self.pairs.get(run[at - 1 : at] + EDGE, self.unseen)
                for (k, state, read), (total, start) in paths.items():
                    if read == self.steps[k].count:
                        total += self.steps[k].end[state] - edge - least_margin
                        # a margin that is just enough is enough
                        if total > best or (total == best and last == chosen[start]):
                            best, last = total, (start, at)
                chosen[at], sums[at] = last, best
                edge = self.pairs.get(EDGE + run[at : at + 1], self.unseen)
                for k, s in enumerate(self.steps):
                    paths[k, 0, 0] = (best + s.share - edge, at)
            if not paths or at == len(run):
                continue
            pair = self.pairs.get(run[at - 1 : at + 1], self.unseen) if at else 0.0
            moved: dict[tuple[int, int, int], tuple[float, int]] = {}
            for (k, state, read), (total, start) in paths.items():
                s = self.steps[k]
                step = s.step(state, read, run[at])
                if step is None:
                    continue
                key = (k, step[1], min(read + 1, s.count))
                total += step[0] - (pair if read else 0.0)
                if key not in moved or total > moved[key][0]:
                    moved[key] = (total, start)
            paths = moved
        found = []
        while last is not None:
            found.append(last)
            last = chosen[last[0]]
        return found[::-1]


def touched(run: tuple[int, int], base: list[Span]) -> list[Span]:
    """The base spans that touch a run, where they overlap as one of the first's kind."""
    tied: list[Span] = []
    for s, e, kind in base:
        if s < run[1] and e > run[0]:
            if tied and s < tied[-1][1]:
                tied[-1] = (tied[-1][0], max(e, tied[-1][1]), tied[-1][2])
            else:
                tied.append((s, e, kind))
    return tied


def runs(text: str, base: list[Span]) -> Iterator[tuple[int, int, list[Span]]]:
    """Runs of candidate letters with the base spans that touch each."""
    at = 0
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][1] <= m.start():
            at += 1
        # by start, so that the first one behind the run ends the search
        end = at
        while end < len(base) and base[end][0] < m.end():
            end += 1
        yield m.start(), m.end(), touched(m.span(), base[at:end])


def ordinary_runs(text: str, base: list[Span]) -> list[str]:
    """The runs, and what base spans leave of a run."""
    if not base:
        return CANDIDATE.findall(text)
    found = []
    for start, end, spans in runs(text, base):
        for s, e, _ in [*spans, (end, end, "")]:
            if s - start >= SHORTEST:
                found.append(text[start:s])
            start = max(start, e)
    return found


def format_spans(
    text: str, base: list[Span], formats: Formats | None, least_margin: float
) -> list[tuple[int, int]]:
    """Places of the candidates that are reported."""
    if formats is None:
        return []
    if not base:
        found = []
        for m in CANDIDATE.finditer(text):
            more = formats.spans(m[0], least_margin)
            if more:
                found += [(m.start() + s, m.start() + e) for s, e in more]
        return found
    found = []
    for start, end, spans in runs(text, base):
        run, inside = text[start:end], []
        for s, e, kind in spans:
            # an assignment's secret ends it; its word may stand in a run before
            margin = formats.margin(credential(text, (s, e, kind))) if e <= end else 0.0
            inside.append((max(s, start) - start, min(e, end) - start, max(margin, 0.0)))
        if not inside:
            more = formats.spans(run, least_margin)
        elif inside[0][:2] == (0, len(run)):
            more = []
        else:
            found_in = formats.parse(run, least_margin, inside)
            more = [p for p in found_in if p not in {i[:2] for i in inside}]
        found += [(start + s, start + e) for s, e in more]
    return found


def pairs_of(runs: list[str]) -> dict[str, int]:
    """Counts of letter pairs, with each run's start and end."""
    # an edge between two runs is the end of one and the start of the next
    if not runs:
        return {}
    codes = np.frombuffer(EDGE.join(["", *runs, ""]).encode(), np.uint8).astype(np.int32)
    counts = np.bincount(codes[:-1] * 128 + codes[1:])
    return {chr(i // 128) + chr(i % 128): int(counts[i]) for i in np.flatnonzero(counts)}


def learn(docs: DataFrame, examples: int = 600, alpha: float = 0.05) -> Formats | None:
    """Formats from all of the corpus. Of each kind the `examples` distinct credentials
    of smallest hash are the labelled sample; pair counts cover every ordinary run."""
    rows = id_and_text(docs)

    def run(batch: pa.RecordBatch) -> dict:
        found, ordinary = set(), []
        for t in texts(batch):
            base = base_spans(t)
            found |= {(s[2], credential(t, s)) for s in base}
            ordinary += ordinary_runs(t, base)
        pairs = pairs_of(ordinary)
        kinds, words = zip(*sorted(found)) if found else ((), ())
        return {
            "kind": [*kinds, *["pair"] * len(pairs)],
            "word": [*words, *pairs],
            "n": [*[1] * len(words), *pairs.values()],
        }

    seen = map_slices(rows, run, "kind string, word string, n long").groupBy("kind", "word")
    seen = saved(seen.agg(F.sum("n").alias("n")))
    # at most one row for two letters of the candidates' alphabet
    counts = {r.word: r.n for r in seen.filter("kind = 'pair'").collect()}
    samples = {
        k: [
            r.word
            for r in seen.filter(F.col("kind") == k)
            .orderBy(F.xxhash64("word"), "word")
            .limit(examples)
            .collect()
        ]
        for k in KINDS
    }
    total = sum(map(len, samples.values()))
    if not total:
        return None
    after = Counter()
    for pair, n in counts.items():
        after[pair[0]] += n
    letters = 68
    pairs = {p: math.log((n + 1) / (after[p[0]] + letters)) for p, n in counts.items()}
    automata = [(len(w) / total, Automaton(sorted(w), alpha)) for w in samples.values() if w]
    return Formats(automata, pairs, math.log(1 / letters))


def scan(docs: DataFrame, formats: Formats | None, least_margin: float = 5.0) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (base ones and
    `format` ones, whose margin is `least_margin` at least)."""

    def run(batch: pa.RecordBatch) -> dict:
        bases, everything = [], []
        for t in texts(batch):
            base = base_spans(t)
            more = [(s, e, "format") for s, e in format_spans(t, base, formats, least_margin)]
            bases.append(base)
            everything.append(
                sorted(base + more, key=lambda s: (s[0], [*KINDS, "format"].index(s[2])))
            )
        counts = [Counter(k for _, _, k in b) for b in bases]
        return {
            "doc_id": batch.column("doc_id"),
            **{f"n_{k}": [c[k] for c in counts] for k in KINDS},
            "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in bases],
            "spans": [joined(s) for s in everything],
        }

    return map_slices(
        id_and_text(docs),
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )


def redact(
    docs: DataFrame,
    formats: Formats | None,
    mark: str = "<secret>",
    least_margin: float = 5.0,
    text_col: str = "text",
) -> DataFrame:
    """The rows with `mark` in place of every span; overlapping spans get one mark.
    Null texts stay null."""

    @F.pandas_udf("string")
    def clean(column):
        return column.map(one)

    def one(t: str | None) -> str | None:
        if not t:
            return t
        base = base_spans(t)
        spans = [(s, e) for s, e, _ in base]
        spans += format_spans(t, base, formats, least_margin)
        out, at = [], 0
        for s, e in sorted(spans):
            if s >= at:
                out += [t[at:s], mark]
            at = max(at, e)
        return "".join([*out, t[at:]])

    return docs.withColumn(text_col, clean(F.col(text_col)))
