"""Secret scans: fixed patterns, and formats inferred from labelled credentials.

Grammar inference: the credentials of a kind, as sequences of character classes, make a prefix tree with counts. From its root
on, each state is merged with the most similar earlier one that is statistically compatible with it, or else stays a state of its own.
Two states are compatible if what follows them is alike within the Hoeffding bound for their numbers of visits: how often each class comes
so many characters on (for ``AHEAD`` characters), and how much of the credential is left. What follows a merged state is that of all
credentials that have come to it, so counts add up as states merge. The outcome is a probabilistic automaton for each kind, its
probabilities drawn towards the kind's class frequencies where visits are few. Every candidate token is scored by its log-likelihood per
character, end included, under each automaton; it is a secret if it reaches what nearly all held-out credentials of that
kind reach, and looks more like them than like ordinary tokens.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import Stash, pieces, small_batches, texts_of

#: The patterns of the base kinds, the least length of what they find, in order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "format")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Maximal runs of credential characters are the candidates, from so many characters or the length of the shortest learned credential on.
CANDIDATES = 16
_RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
CANDIDATE = re.compile((_RUN % LEAST["assign"]).encode())
_IS_HEX = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_IS_CANDIDATE = bytes(49 if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_=-") else 48 for b in range(256))
_CLASSES = bytes(48 if chr(b).isascii() and chr(b).isdigit() else 97 if 97 <= b <= 122 else 65 if 65 <= b <= 90 else b for b in range(256))
#: Class sequences of a task that are counted at a time, and characters that an ordinary token weighs as at most: of longer ones all are
#: counted, but their numbers scaled down to that, so that a few long ones do not decide what is ordinary.
_COUNTED, _WEIGHT = 100_000, 1 << 13

#: What follows these words is labelled as a credential for learning only: base spans are by the patterns above alone.
CONTEXT = re.compile(r"""(?<![A-Za-z])(?:bearer|basic|credential|access[_-]key|private[_-]key|client[_-]secret|api-key|auth|pwd|passphrase)["']?\x20*[:=\x20]\x20*["']?(?=[A-Za-z+/_=-]*[0-9])([A-Za-z0-9+/_=-]{16,})""", re.I | re.A)
_CONTEXT_WORDS = (b"bearer", b"basic", b"credential", b"access", b"private", b"client", b"api-key", b"auth", b"pwd", b"passphrase")

#: Credentials that a kind's automaton is inferred from, at most; half of them set its limit.
SAMPLE = 1000
#: Characters of a kind's sample, and of its credentials that go into one prefix tree. Credentials come whole, in the order of
#: a hash: each that still fits, and at least the shortest.
CHARACTERS, TREE = 1 << 24, 1 << 19
ALPHA = 0.005
#: Characters ahead that are compared one by one, and the lengths left that are (longer ones by sixteenths of an octave).
AHEAD, LEFT = 24, 128
#: Characters that credentials are followed at a time, and states that are compared by all that follows them at once.
_FOLLOWED, _FEW = 1 << 14, 64
#: Visits that the prior of a state's probabilities counts as.
PRIOR = 2.0
#: The share of held-out credentials that may fall short of the limit, which is lower by SLACK / sqrt(their number).
LIMIT_QUANTILE, SLACK = 0.02, 0.5
#: Bits a character, and for the whole token, that a learned format must be ahead of ordinary tokens.
MARGIN, LEAST_BITS = 0.5, 16
#: Weight of a class's own frequency against its frequency after the class before it.
_OWN = 64
#: Outcomes of so many class sequences, of so many characters at most, are remembered.
_MEMO, _SHORT = 100_000, 64
_SIEVE = 1 << 30


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds; ``raw`` is the text's UTF-8, looked at first as most texts have nothing."""
    out = []
    low = raw.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"1" * LEAST["hex"] in raw.translate(_IS_HEX):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def secret_of(kind: int, text: str, start: int, end: int) -> str:
    """The credential itself: what is assigned, or the whole span."""
    return ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]


def classes(token: str) -> str:
    """Digits as 0, lower-case letters as a, capitals as A, other characters as they are."""
    if token.isascii():
        return token.translate(_ASCII)
    return "".join("0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in token)


_ASCII = {b: c for b, c in enumerate(_CLASSES[:128])}
_SPREAD = {"0": 10, "a": 26, "A": 26}


@dataclass
class Automaton:
    """From each state, where each class leads to and its probability, and that of the end."""

    step: list[dict[str, int]]
    chance: list[dict[str, float]]
    end: list[float]
    limit: float = 0.0

    def __post_init__(self):
        goes = zip(self.step, self.chance, strict=True)
        self.bits = [{c: (after[c], math.log2(p / _SPREAD.get(c, 1))) for c, p in own.items() if p} for after, own in goes]

    def score(self, token: str, least: float = -math.inf) -> float:
        """Bits a character of the token's likelihood (0 is certain), or -inf as soon as they are sure to be below ``least``."""
        state, bits = 0, 0.0
        symbols = classes(token)
        for at in range(0, len(symbols), _FOLLOWED):
            for c in symbols[at : at + _FOLLOWED]:
                known = self.bits[state].get(c)
                if known is None:
                    return -math.inf
                state = known[0]
                bits += known[1]
            if bits / len(symbols) < least:
                return -math.inf
        bits += math.log2(self.end[state])
        return bits / max(1, len(symbols))


class _Merging:
    """The prefix tree of some class sequences, its states merged one by one."""

    def __init__(self, tokens: list[str], alpha: float):
        symbols = [classes(t) for t in tokens]
        self.alphabet = sorted(set().union(*symbols))
        self.over = len(self.alphabet)  # the symbol of the end; one more stands for what lies beyond
        code = {c: k for k, c in enumerate(self.alphabet)}
        self.length = np.array([len(s) for s in symbols], np.int64)
        room = self.length + AHEAD + 1
        self.begin = np.cumsum(room) - room
        self.sequences = np.full(int(room.sum()) + _FOLLOWED, self.over + 1, np.int16)  # one after the other
        for k, s in zip(self.begin.tolist(), symbols, strict=True):
            self.sequences[k : k + len(s)] = np.fromiter(map(code.__getitem__, s), np.int16, len(s))
            self.sequences[k + len(s)] = self.over
        self.cut = AHEAD * (self.over + 1)
        self.spread = math.sqrt(0.5 * math.log(2 / alpha))
        self.states = 0
        self.visits = np.zeros(64, np.int64)
        self.ahead = np.zeros((64, self.cut + 1 + int(self._left(self.length).max(initial=0))), np.int32)  # by state: counts of (characters on, symbol), and of how much is left
        self.flow = np.zeros((64, self.over + 1), np.int64)
        self.step: list[dict[int, int]] = []
        self.waiting: list[list[tuple[np.ndarray, np.ndarray]]] = []  # credentials, and places in them, that have come to a state not yet settled
        self.open: dict[int, tuple[int, int]] = {}  # states not yet settled: the state and symbol before them

    @staticmethod
    def _left(n: np.ndarray) -> np.ndarray:
        return np.where(n < LEFT, n, LEFT + np.floor(16 * np.log2(np.maximum(n, LEFT) / LEFT)).astype(np.int64))

    def _new(self) -> int:
        if self.states == len(self.visits):
            self.visits, self.ahead, self.flow = (np.concatenate([x, np.zeros_like(x)]) for x in (self.visits, self.ahead, self.flow))
        self.step.append({}), self.waiting.append([])
        self.states += 1
        return self.states - 1

    def _count(self, state: int, which: np.ndarray, at: np.ndarray) -> None:
        """Counts credentials at places in them, for one state."""
        own = self.sequences[(self.begin[which] + at)[:, None] + np.arange(AHEAD)]
        place = np.arange(AHEAD) * (self.over + 1) + own
        self.visits[state] += len(which)
        self.ahead[state, : self.cut] += np.bincount(place[own <= self.over], minlength=self.cut)
        left = np.bincount(self._left(self.length[which] - at))
        self.ahead[state, self.cut : self.cut + len(left)] += left

    def _count_path(self, path: list[int], symbols: list[int], which: np.ndarray, at: np.ndarray) -> None:
        """Counts credentials at the states they come through one after the other, and their symbols there."""
        states = np.array(path)
        row, places = states * self.ahead.shape[1], at[:, None] + np.arange(len(path))
        own = self.sequences[(self.begin[which][:, None] + places)[:, :, None] + np.arange(AHEAD)]
        counted = row[:, None] + np.arange(AHEAD) * (self.over + 1) + own
        counts = self.ahead.reshape(-1)
        np.add.at(counts, counted[own <= self.over], 1)
        np.add.at(counts, (row + self.cut + self._left(self.length[which][:, None] - places)).ravel(), 1)
        np.add.at(self.flow.reshape(-1), states * (self.over + 1) + symbols, len(which))
        np.add.at(self.visits, states, len(which))

    def _come(self, state: int, which: np.ndarray, at: np.ndarray) -> None:
        """Credentials come to a state, and from settled ones go on."""
        todo = [(state, which, at)]
        while todo:
            state, which, at = todo.pop()
            if self.step[state]:
                state, at = self._along(state, which, at)
            self._count(state, which, at)
            if state in self.open:
                self.waiting[state].append((which, at))
            else:
                todo += self._onward(state, which, at)

    def _along(self, state: int, which: np.ndarray, at: np.ndarray) -> tuple[int, np.ndarray]:
        """Follows credentials as long as all have the same symbols and a settled state knows the next one; where they are then."""
        look = 1
        while True:
            n = max(1, min(look, _FOLLOWED // len(which)))
            block = self.sequences[(self.begin[which] + at)[:, None] + np.arange(n)]
            same = (block == block[0]).all(0) & (block[0] < self.over)
            symbols = block[0, : n if same.all() else int(same.argmin())].tolist()
            path = []
            for c in symbols:
                after = self.step[state].get(c)
                if after is None:
                    break
                path.append(state)
                state = after
            if path:
                self._count_path(path, symbols[: len(path)], which, at)
                at = at + len(path)
            if len(path) < n:
                return state, at
            look = min(4 * look, _FOLLOWED)

    def _onward(self, state: int, which: np.ndarray, at: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        after, out = self.sequences[self.begin[which] + at], []
        for c in np.unique(after[after <= self.over]).tolist():
            mine = after == c
            self.flow[state, c] += mine.sum()
            if c < self.over:
                if c not in self.step[state]:
                    self.step[state][c] = self._new()
                    self.open[self.step[state][c]] = state, c
                out.append((self.step[state][c], which[mine], at[mine] + 1))
        return out

    def _settle(self, state: int) -> None:
        del self.open[state]
        held, self.waiting[state] = self.waiting[state], []
        for which, at in held:
            for go in self._onward(state, which, at):
                self._come(*go)

    def _profiles(self, states: list[int]) -> np.ndarray:
        p = self.ahead[states] / np.maximum(1, self.visits[states])[:, None]
        p[:, self.cut :] = p[:, self.cut :].cumsum(1)
        return p

    def _alike(self, kept: list[int], blue: int) -> int | None:
        """The most similar of the kept states that is compatible with another one; of many, the next characters rule out most."""
        visits, states, own = self.visits[kept], np.array(kept), self._profiles([blue])[0]
        bound = self.spread * (1 / np.sqrt(visits) + 1 / math.sqrt(self.visits[blue]))
        near, k = np.arange(len(kept)), 0
        while len(near) > _FEW and k < self.cut:
            some = slice(k, k + self.over + 1)
            off = np.abs(self.ahead[states[near], some] / np.maximum(1, visits[near])[:, None] - own[some]).max(1)
            near, k = near[off / bound[near] <= 1], some.stop
        if not len(near):
            return None
        off = np.abs(self._profiles(states[near]) - own).max(1) / bound[near]
        best = int(off.argmin())
        return kept[near[best]] if off[best] <= 1 else None

    def run(self) -> list[int]:
        """Settles all states; returns those that are left, the first one first."""
        root = self._new()
        self.open[root] = root, self.over
        self._come(root, np.arange(len(self.length)), np.zeros(len(self.length), np.int64))
        kept = [root]
        self._settle(root)
        while self.open:
            blue = max(self.open, key=lambda t: (self.visits[t], -t))
            parent, symbol = self.open[blue]
            alike = self._alike(kept, blue)
            if alike is None:
                kept.append(blue)
                self._settle(blue)
            else:
                del self.open[blue]
                self.step[parent][symbol] = alike
                for which, at in self.waiting[blue]:
                    self._come(alike, which, at)
        return kept


def infer(tokens: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of some credentials, by state merging."""
    tree = _Merging(tokens, alpha)
    kept = tree.run()
    place = {s: k for k, s in enumerate(kept)}
    total = tree.flow[kept].sum(0)
    prior = (total + 1) / (total + 1).sum()
    step, chance, end = [], [], []
    for s in kept:
        flow = tree.flow[s]
        p = (flow + PRIOR * prior) / (flow.sum() + PRIOR)
        goes = {c: place[t] for c, t in tree.step[s].items()}
        most = max(goes, key=lambda c: (flow[c], -c)) if goes else None  # where a class leads to that was never seen here
        step.append({} if most is None else {name: goes.get(c, goes[most]) for c, name in enumerate(tree.alphabet)})
        chance.append({name: float(p[c]) for c, name in enumerate(tree.alphabet) if name in step[-1]})
        end.append(float(p[-1]))
    return Automaton(step, chance, end)


@dataclass
class Formats:
    """Automata by kind, the bits of classes of ordinary tokens (after another class, or ^ at the start), and the least length of candidates."""

    automata: dict[str, Automaton]
    plain: dict[str, float]
    least: int = CANDIDATES

    def __post_init__(self):
        self.memo: dict[str, str | None] = {}
        self.candidate = re.compile((_RUN % self.least).encode())

    def spread(self, token: str) -> float:
        symbols = classes(token)
        return sum(self.plain.get(x + c, -8.0) for x, c in zip("^" + symbols, symbols, strict=False)) / max(1, len(symbols))

    def match(self, token: str) -> str | None:
        """The kind whose format the token has."""
        symbols = classes(token)
        if len(symbols) > _SHORT:
            return self._match(symbols)
        if symbols not in self.memo:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            self.memo[symbols] = self._match(symbols)
        return self.memo[symbols]

    def _match(self, symbols: str) -> str | None:
        least = self.spread(symbols) + max(MARGIN, LEAST_BITS / max(1, len(symbols)))
        best = None
        for kind, automaton in self.automata.items():
            score = automaton.score(symbols, max(least, automaton.limit))
            if score >= automaton.limit and score >= least and (best is None or score > best[0]):
                best = (score, kind)
        return best and best[1]


def fitting(sizes: list[int], most: int) -> list[int]:
    """Which of some sizes are taken if each is that still fits, and at least the smallest."""
    out, left = [], most
    for k, n in enumerate(sizes):
        if n <= left:
            out.append(k)
            left -= n
    return out or [sizes.index(min(sizes))]


def formats(credentials: dict[str, list[str]], plain: dict[str, int]) -> Formats:
    automata, least = {}, []
    for kind, tokens in sorted(credentials.items()):
        tokens = sorted(set(tokens))
        own, held = tokens[::2], tokens[1::2] or tokens
        if sum(map(len, own)) > TREE:
            own.sort(key=lambda t: (zlib.crc32(t.encode()), t))
            own = [own[k] for k in fitting([len(t) for t in own], TREE)]
        automaton = infer(own)
        scores = sorted(automaton.score(t) for t in held)
        automaton.limit = scores[int(len(scores) * LIMIT_QUANTILE)] - SLACK / math.sqrt(len(scores))
        automata[kind] = automaton
        least.append(len(min(tokens, key=len)))
    total, own, before = sum(plain.values()), Counter(), Counter()
    for pair, n in plain.items():
        own[pair[-1]] += n
        before[pair[:-1]] += n
    share = {c: (n + 1) / (total + 64) for c, n in own.items()}
    pairs = {x + c: (plain.get(x + c, 0) + _OWN * p) / (before.get(x, 0) + _OWN) for x in ("^", "0", "a", "A", *"+/_=-") for c, p in share.items()}
    bits = {pair: math.log2(p / _SPREAD.get(pair[1], 1)) for pair, p in pairs.items()}
    return Formats(automata, bits, min([CANDIDATES, *least]))


def all_spans(text: str, raw: bytes, learned: Formats | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base and learned ones); learned spans overlap no base span."""
    base = base_spans(text, raw)
    if learned is None or not learned.automata or b"1" * learned.least not in raw.translate(_IS_CANDIDATE):
        return base, base
    more = []
    for m in learned.candidate.finditer(raw.translate(_CLASSES)):
        if learned.match(m[0].decode()):
            a = m.start() if text.isascii() else len(raw[: m.start()].decode())
            b = a + m.end() - m.start()
            if not any(x < b and a < y for x, _, y in base):
                more.append((a, 3, b))
    return base, sorted(base + more)


def _labelled(batches):
    """(kind, token, n): the credentials of base spans and of contexts, and under kind '' the classes, each with the one before it, of all other candidates."""
    names, pairs, ordinary = ["kind", "token", "n"], Counter(), Counter()

    def rows(counts: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([t for _, t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names)

    def count() -> None:
        for raw, n in ordinary.items():
            symbols = raw.decode()
            for x, c in zip("^" + symbols, symbols, strict=False):
                pairs[x + c] += n
        ordinary.clear()

    for batch in pieces(batches):
        found: Counter = Counter()
        for raw in texts_of(batch, "text"):
            text = raw.decode("utf-8", "replace")
            spans = base_spans(text, raw)
            for start, kind, end in spans:
                found[KINDS[kind], secret_of(kind, text, start, end)] += 1
            low = raw.lower()
            if any(w in low for w in _CONTEXT_WORDS):
                for m in CONTEXT.finditer(text):
                    if not any(x < m.end() and m.start() < y for x, _, y in spans):
                        found["context", m[1]] += 1
                        spans = [*spans, (m.start(), 3, m.end())]
            if b"1" * LEAST["assign"] in raw.translate(_IS_CANDIDATE):
                if spans:  # what they cover is no ordinary token
                    for x, _, y in reversed(spans):
                        text = text[:x] + " " * (y - x) + text[y:]
                    raw = text.encode()
                for m in CANDIDATE.finditer(raw.translate(_CLASSES)):
                    if m.end() - m.start() <= _SHORT:
                        ordinary[m[0]] += 1
                    else:  # held no longer than it is counted
                        symbols = m[0].decode()
                        for pair, n in Counter(map(add, "^" + symbols, symbols)).items():
                            pairs[pair] += -(-n * min(len(symbols), _WEIGHT) // len(symbols))
        if len(ordinary) > _COUNTED:
            count()
        yield rows(found)
    count()
    yield rows({("", pair): n for pair, n in pairs.items()})


def _placed(spans: list[tuple[int, int, int]], text: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = end
    return "".join(out) + text[at:]


class SecretScan:
    """Finds credentials by fixed patterns and by formats learned from labelled ones.

    ``learn`` infers the formats from the credentials that the fixed patterns and ``CONTEXT`` label in all documents, and those of
    ``labelled`` (kind, token) if given; ``SAMPLE`` of a kind at most and ``CHARACTERS`` of them, chosen by a hash, of few as many as
    there are. They are learned from whole. ``scan`` returns a
    row per document row: id, ``base`` and ``spans`` (arrays of kind, start, end; code points, end exclusive; by start,
    then kind). ``redact`` puts ``[SECRET]`` for each span (spans that overlap count as one) and keeps every row
    and column; the column ``length``, if the table has it, counts the new text where it changed. Null and empty
    texts have no spans and stay as they are. Texts and tokens are read whole. Of formats that match equally well
    the first by name counts. Repeated rows scan alike; further columns are ignored or carried. An empty table teaches nothing and gives no rows.
    """

    def learn(self, docs: DataFrame, text: str = "text", labelled: DataFrame | None = None) -> Formats:
        stash = Stash(docs.sparkSession, "secrets")
        found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_labelled, "kind string, token string, n long")
        if labelled is not None:
            found = found.unionByName(labelled.select("kind", "token", F.lit(1).cast("long").alias("n")).where("kind <> '' and token <> ''"))
        found = stash.put("tokens", found)
        plain = {r["token"]: r["n"] for r in found.where("kind = ''").groupBy("token").agg(F.sum("n").alias("n")).collect()}
        different = {r["kind"]: r["n"] for r in found.where("kind <> ''").groupBy("kind").agg(F.approx_count_distinct("token").alias("n")).collect()}
        credentials: dict[str, list[str]] = {}
        for kind, n in sorted(different.items()):
            own = found.where(F.col("kind") == kind).select("token", F.xxhash64("token").alias("chance"))
            if n > 4 * SAMPLE:  # so only some go through the shuffle
                own = own.where(F.pmod("chance", F.lit(_SIEVE)) < int(_SIEVE * 4 * SAMPLE / n))
            sizes = own.select("chance", F.length("token").alias("size")).distinct().orderBy(F.pmod("chance", F.lit(_SIEVE)), "chance").limit(SAMPLE).collect()
            chosen = [sizes[k]["chance"] for k in fitting([r["size"] for r in sizes], CHARACTERS)] if sizes else []
            rows = own.where(F.col("chance").isin(chosen)).distinct().collect()
            credentials[kind] = [r["token"] for r in rows]
        stash.drop("tokens")
        return formats(credentials, plain)

    def scan(self, docs: DataFrame, learned: Formats | None, id_: str = "doc_id", text: str = "text") -> DataFrame:
        spark = docs.sparkSession
        small_batches(spark)
        held = _sent(spark, learned)
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def run(batches):
            formats_ = _received(held)
            for batch in pieces(batches):
                found = [all_spans(raw.decode("utf-8", "replace"), raw, formats_) for raw in texts_of(batch, "text")]
                columns = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in f[j]] for f in found], span) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_, "base", "spans"])

        spans = "array<struct<kind: string, start: bigint, end: bigint>>"
        schema = T.StructType([T.StructField(id_, docs.schema[id_].dataType), T.StructField("base", T._parse_datatype_string(spans)), T.StructField("spans", T._parse_datatype_string(spans))])
        return docs.select(F.col(id_), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)

    def redact(self, docs: DataFrame, learned: Formats | None, text: str = "text", length: str = "n_chars") -> DataFrame:
        spark = docs.sparkSession
        small_batches(spark)
        held = _sent(spark, learned)

        def run(batches):
            formats_ = _received(held)
            for batch in pieces(batches):
                k = batch.schema.get_field_index(text)
                texts, new = batch.column(k).to_pylist(), {}
                for i, raw in enumerate(texts_of(batch, text)):
                    spans = all_spans(texts[i], raw, formats_)[1] if raw else []
                    if spans:
                        new[i] = _placed(spans, texts[i])
                columns = list(batch.columns)
                if new:
                    columns[k] = pa.array([new.get(i, t) for i, t in enumerate(texts)], columns[k].type)
                    if (n := batch.schema.get_field_index(length)) >= 0:
                        columns[n] = pa.array([len(new[i]) if i in new else v for i, v in enumerate(columns[n].to_pylist())], columns[n].type)
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        return docs.mapInArrow(run, docs.schema)


def _sent(spark, learned: Formats | None):
    plain = None if learned is None else ({k: (a.step, a.chance, a.end, a.limit) for k, a in learned.automata.items()}, learned.plain, learned.least)
    return spark.sparkContext.broadcast(plain)


def _received(held) -> Formats | None:
    if held.value is None:
        return None
    automata, plain, least = held.value
    return Formats({k: Automaton(*a) for k, a in automata.items()}, plain, least)

