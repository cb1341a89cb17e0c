"""Secret scans by one combined deterministic automaton.

Each rule's regular expression is parsed into a nondeterministic automaton over bytes. Subset
construction with ordered threads gives its leftmost, greedy search: a thread that began later is cut as
soon as an earlier one accepts. The rules' automata run side by side as one product automaton, which is
minimised by partition refinement and written out as one flat transition array over byte classes. A text
is then read once, byte by byte, for all rules.

A rule must end in a maximal run or at a fixed place: once it accepts, each further byte either accepts
again or ends the match. That is checked when it is compiled. A match that fails its rule's last check
(a minimum length) still uses up its text. A match's start is found from its end by the reversed rule.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risetide.llm.work import text_bytes


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0        # characters of the last run, or of the whole match where run is None
    run: str | None = None
    any_case: bool = False


#: The base rules' patterns and lengths.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6,
         "A-Za-z0-9+/_.=-", True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE = (
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


class _Nfa:
    """Byte automaton with empty moves; move order is priority order."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def build(self, items, start: int, any_case: bool, backwards: bool) -> int:
        """Append a parsed sequence after start; returns where it ends."""
        for op, arg in reversed(items) if backwards else items:
            start = self._item(op, arg, start, any_case, backwards)
        return start

    def _bytes(self, chosen: set[int], start: int, any_case: bool) -> int:
        if any_case:
            chosen = chosen | {ord(chr(b).swapcase()) for b in chosen if b < 128}
        end = self.state()
        self.moves[start] = (frozenset(chosen), end)
        return end

    def _item(self, op, arg, start: int, any_case: bool, backwards: bool) -> int:
        if op is sre.LITERAL:
            return self._bytes({arg}, start, any_case)
        if op is sre.IN:
            chosen: set[int] = set()
            for kind, value in arg:
                if kind not in (sre.LITERAL, sre.RANGE):
                    raise ValueError(f"not supported in a class: {kind}")
                chosen |= {value} if kind is sre.LITERAL else set(range(value[0], value[1] + 1))
            return self._bytes(chosen, start, any_case)
        if op is sre.SUBPATTERN:
            return self.build(arg[3], start, any_case, backwards)
        if op is sre.BRANCH:
            end = self.state()
            for branch in arg[1]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.build(branch, begin, any_case, backwards)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            low, high, inner = arg
            for _ in range(low):
                start = self.build(inner, self._after(start), any_case, backwards)
            if high is sre.MAXREPEAT:
                begin, end = self.state(), self.state()
                self.empty[start] += [begin, end]
                self.empty[self.build(inner, begin, any_case, backwards)].append(start)
                return end
            end = self.state()
            for _ in range(high - low):
                begin = self.state()
                self.empty[start] += [begin, end]
                start = self.build(inner, begin, any_case, backwards)
            self.empty[start].append(end)
            return end
        raise ValueError(f"not supported: {op}")

    def _after(self, start: int) -> int:
        fresh = self.state()
        self.empty[start].append(fresh)
        return fresh

    def closure(self, states: list[int]) -> list[int]:
        found, seen = [], set()
        stack = list(reversed(states))
        while stack:
            s = stack.pop()
            if s not in seen:
                seen.add(s)
                found.append(s)
                stack += reversed(self.empty[s])
        return found


class _Automaton:
    """Deterministic automaton of one rule: rows of next states for the 256 bytes, -1 for none."""

    def __init__(self, rule: Rule, backwards: bool = False):
        nfa = _Nfa()
        first = nfa.state()
        parsed = list(sre_parser.parse(rule.pattern))
        last = nfa.build(parsed, first, rule.any_case, backwards)
        search = not backwards
        begin = (tuple(nfa.closure([first])),)
        self.rows: list[list[int]] = []
        self.accepts: list[bool] = []
        number = {begin: 0}
        todo = [begin]
        while todo:
            groups = todo.pop(0)     # threads by where they began, the earliest first
            self.accepts.append(any(last in g for g in groups[:1]))
            matched = self.accepts[-1]
            row = []
            for b in range(256):
                following, seen = [], set()
                for g in groups[:1] if matched else groups:
                    to = nfa.closure([nfa.moves[s][1] for s in g if nfa.moves[s] and b in nfa.moves[s][0]])
                    to = tuple(s for s in to if s not in seen)
                    seen |= set(to)
                    if to:
                        following.append(to)
                        if last in to:
                            break
                if matched and search and following and last not in following[0]:
                    raise ValueError(f"{rule.kind}: a match that is complete may go on to fail")
                if following and last in following[-1]:
                    # the earliest thread that accepts; earlier ones may still win, so they stay in front
                    if len(following) > 1:
                        raise ValueError(f"{rule.kind}: an earlier start is still open when a later one accepts")
                elif search and not (matched and following):
                    # the text may begin a match here, behind those already begun
                    fresh = tuple(s for s in begin[0] if s not in seen)
                    following.append(fresh)
                key = tuple(following)
                if not key:
                    row.append(-1)
                    continue
                if matched and search and not (last in key[0]):
                    # the match ended before this byte, which may begin the next one
                    key = self._restart(nfa, begin, b, last)
                if key not in number:
                    number[key] = len(number)
                    todo.append(key)
                row.append(number[key])
            self.rows.append(row)

    @staticmethod
    def _restart(nfa: _Nfa, begin, b: int, last: int):
        to = tuple(nfa.closure([nfa.moves[s][1] for s in begin[0] if nfa.moves[s] and b in nfa.moves[s][0]]))
        if last in to:
            return (to,)
        fresh = tuple(s for s in begin[0] if s not in to)
        return tuple(x for x in (to, fresh) if x)


def minimised(rows: list[list[int]], outputs: list[int]) -> tuple[list[list[int]], list[int]]:
    """Partition refinement: states stay apart only if some text tells them apart. State 0 stays first."""
    block = list(outputs)
    count = len(set(block))
    while True:
        number: dict[tuple, int] = {}
        block = [number.setdefault((block[s], *(block[t] for t in rows[s])), len(number)) for s in range(len(rows))]
        if len(number) == count:
            break
        count = len(number)
    one = {b: s for s, b in reversed(list(enumerate(block)))}
    return [[block[t] for t in rows[one[b]]] for b in range(count)], [outputs[one[b]] for b in range(count)]


class Scanner:
    """All rules as one transition array."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        autos = [_Automaton(r) for r in rules]
        self._reversed = [_Automaton(r, backwards=True) for r in rules]
        # bytes that no rule tells apart share a class
        columns: dict[tuple, int] = {}
        of_byte = [columns.setdefault(tuple(r[b] for a in autos for r in a.rows), len(columns)) for b in range(256)]
        width = len(columns)
        sample = [of_byte.index(c) for c in range(width)]
        begin = (0,) * len(autos)
        number, todo, rows, outputs = {begin: 0}, [begin], [], []
        while todo:
            state = todo.pop()
            mask = sum(1 << i for i, (a, s) in enumerate(zip(autos, state)) if a.accepts[s])
            row = []
            for b in sample:
                to = tuple(a.rows[s][b] for a, s in zip(autos, state))
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append((number[state], row))
            outputs.append((number[state], mask))
        rows = [r for _, r in sorted(rows)]
        outputs = [m for _, m in sorted(outputs)]
        small, masks = minimised(rows, outputs)
        # quiet states first, so that one comparison tells a state that accepts
        order = sorted(range(len(small)), key=lambda s: (masks[s] != 0, s))
        place = {s: i * width for i, s in enumerate(order)}
        self.start = place[0]
        self.table = [place[t] for s in order for t in small[s]]
        self.masks = {place[s]: masks[s] for s in order if masks[s]}
        self.hot = min(self.masks)
        self.classes = bytes(of_byte)
        self.states, self.product = len(small), len(rows)

    def ends(self, data: bytes) -> list[list[tuple[int, int]]]:
        """For each rule: (first, last) accepting end of each match."""
        state, table, hot = self.start, self.table, self.hot
        seen = []
        for at, c in enumerate(data.translate(self.classes)):
            state = table[state + c]
            if state >= hot:
                seen.append((at + 1, state))
        found: list[list[tuple[int, int]]] = [[] for _ in self.rules]
        for at, state in seen:
            mask = self.masks[state]
            for i in range(len(self.rules)):
                if mask >> i & 1:
                    if found[i] and found[i][-1][1] == at - 1:
                        found[i][-1] = (found[i][-1][0], at)
                    else:
                        found[i].append((at, at))
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) of the matches that pass their check, in bytes, sorted."""
        kept = []
        for i, (rule, ends) in enumerate(zip(self.rules, self.ends(data))):
            low = 0
            for first, end in ends:
                start = self._start(i, data, low, first)
                low = end
                size = end - first + 1 if rule.run is not None else end - start
                if size >= rule.least:
                    kept.append((start, i, end))
        return sorted(kept)

    def _start(self, i: int, data: bytes, low: int, end: int) -> int:
        rows, accepts = self._reversed[i].rows, self._reversed[i].accepts
        state, at, start = 0, end, end
        while at > low and (state := rows[state][data[at - 1]]) >= 0:
            at -= 1
            if accepts[state]:
                start = at
        return start


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points. One walk over the text."""
    places, at, count = {}, 0, 0
    for place in sorted({p for a, _, b in spans for p in (a, b)}):
        count += len(data[at:place].decode("utf-8", "surrogatepass"))
        at = place
        places[place] = count
    return [(places[a], i, places[b]) for a, i, b in spans]


def _text_spans(scan: Scanner, data: bytes) -> list[tuple[int, int, int]]:
    spans = scan.spans(data)
    return spans if data.isascii() else code_points(data, spans)


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kind, start, end) for every secret of docs (doc_id, text); offsets in code points, end
    exclusive. Null texts are empty and hold none; repeated rows repeat; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in batches:
            rows = [(d, s) for d, text in zip(batch.column(0).to_pylist(), batch.column(1)) for s in _text_spans(scan, text.as_py())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in rows], pa.int64()), pa.array([rules[s[1]].kind for _, s in rows], pa.string()),
                 pa.array([s[0] for _, s in rows], pa.int64()), pa.array([s[2] for _, s in rows], pa.int64())],
                ["doc_id", "kind", "start", "end"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, "doc_id long, kind string, start long, end long")


def summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs (doc_id, text).

    Null and empty texts have no spans: zeros, the digest of the empty string, and an empty string.
    Rows are independent, so repeated rows and null doc_ids stay; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, all_spans = [], []
            for text in batch.column(1):
                spans = _text_spans(scan, text.as_py())
                said = [f"{RULES[i].kind}:{a}:{b}" for a, i, b in spans]
                base = ",".join(x for x, (_, i, _) in zip(said, spans) if i < len(BASE))
                for i in range(len(BASE)):
                    counts[i].append(sum(1 for s in spans if s[1] == i))
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                all_spans.append(",".join(said))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
