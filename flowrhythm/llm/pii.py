"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field.

The patterns give the base spans, which always stay. The random field reads the
surroundings of digits, at-signs and spelled-out ones, cut into tokens, and scores whole
segments: how many digits and separators of which kind a segment has, how its digits are
grouped, whether it passes a checksum, what it begins and ends with, what stands beside
it. Dynamic programming over segments of bounded length chooses boundaries and types
together. It is trained on a bounded sample of the corpus, with the base spans as
labels, and on variants of it that the patterns miss (no plus before a phone number, a
spelled-out at or dot in an address, dots in a card number, brackets in an IP address),
so it adds what they leave; dates, versions and the like in their places stay unmarked.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrhythm.llm.common import bounded, materialise

KINDS = ("email", "ip", "card", "phone")
#: Documents of each kind that training reads, whole; windows it takes of one, windows of each kind it uses, rounds.
SAMPLE_DOCS, DOC_WINDOWS, SAMPLE_WINDOWS, ROUNDS = 120, 6, 40, 6
#: Tokens of an entity and of a training window at most, white-space chunks of context, gain that a span must have.
ENTITY_TOKENS, WINDOW_TOKENS, CONTEXT, MIN_GAIN = 32, 80, 2, 2.0
#: Tokens around an entity that its variants are learned with, and how many of them each window gives.
MARGIN, FORMS = 8, 6

Span = tuple[int, int]

_ANY = re.compile("[0-9@]")
#: A spelled-out at-sign, with a word and a dot, or a spelled-out one, after it.
_SPELLED = re.compile(r"(?i)(?<![^\W\d_])at(?![^\W\d_])[\s)\]}>]{1,3}[a-z0-9-]+(?:\.[a-z]|[\s(\[{<]{1,3}dot[\s)\]}>])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """As the pattern finds them, but from the at-sign to both sides, in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _octets(span: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in span.split("."))


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind, leftmost and not overlapping within a kind."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not _ANY.search(text):
        return out
    out["email"] = list(_emails(text))
    out["ip"] = [m.span() for m in _IP.finditer(text) if _octets(m.group())]
    out["card"] = [m.span() for m in _CARD.finditer(text) if 16 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def stretches(text: str) -> Iterator[tuple[int, list[str]]]:
    """(place, tokens) around the chunks that hold a digit, an at-sign or a spelled-out one, of any length."""
    spelled = [m.start() for m in _SPELLED.finditer(text)]
    if not spelled and not _ANY.search(text):
        return
    chunks = [m.span() for m in re.finditer(r"\S+", text)]
    held = {k for k, (a, b) in enumerate(chunks) if _ANY.search(text, a, b)}
    firsts = [a for a, _ in chunks]
    held = sorted(held | {bisect_right(firsts, x) - 1 for x in spelled})
    i = 0
    while i < len(held):
        j = i
        while j + 1 < len(held) and held[j + 1] - held[j] <= 2 * CONTEXT:
            j += 1
        a, b = chunks[max(0, held[i] - CONTEXT)][0], chunks[min(len(chunks) - 1, held[j] + CONTEXT)][1]
        yield a, _TOKEN.findall(text[a:b])
        i = j + 1


def windows(text: str) -> Iterator[tuple[int, list[str]]]:
    """The stretches in parts of at most WINDOW_TOKENS, to train on."""
    for at, tokens in stretches(text):
        for k in range(0, len(tokens), WINDOW_TOKENS):
            part = tokens[k : k + WINDOW_TOKENS]
            yield at, part
            at += sum(map(len, part))


@lru_cache(1 << 14)
def _class(token: str) -> str:
    if token.isdigit() and token.isascii():
        return "9"
    if token.isalpha():
        return {"at": "@", "dot": ":dot"}.get(token.lower(), "a")
    return "_" if token.isspace() else token


def _bucket(n: int) -> str:
    return str(n) if n <= 4 else "5-7" if n <= 7 else "8-9" if n <= 9 else "10-12" if n <= 12 else "13-15" if n <= 15 else "16-19" if n <= 19 else "20+"


def span_features(tokens: list[str], classes: list[str], i: int, j: int) -> list[str]:
    """Of the whole segment from token i to j (exclusive), and of what stands beside it."""
    own = classes[i:j]
    text = "".join(tokens[i:j])
    groups = [len(t) for t, c in zip(tokens[i:j], own) if c == "9"]
    digits = "".join(t for t, c in zip(tokens[i:j], own) if c == "9")
    marks = "".join(sorted({c for c in own if c not in ("9", "a", "_")}))
    out = [
        f"digits {_bucket(len(digits))}", f"groups {'-'.join(map(str, groups)) if len(groups) <= 5 else 'many'}", f"marks {marks}", f"letters {_bucket(sum(c == 'a' for c in own))}",
        f"dots {_bucket(own.count('.'))}", f"ats {own.count('@')}", f"spaces {_bucket(own.count('_'))}", f"begins {own[0]}", f"ends {own[-1]}", f"tokens {_bucket(j - i)}",
        f"before {classes[i - 1] if i else '^'}", f"after {classes[j] if j < len(classes) else '$'}", f"shape {''.join(own[:9])}", f"marks {marks} digits {_bucket(len(digits))}",
    ]
    if 16 <= len(digits) <= 19:
        out.append(f"luhn {luhn(digits)}")
    if own.count(".") == 3 and set(own) == {"9", "."}:
        out.append(f"octets {len(groups) == 4 and text.count('..') == 0 and _octets(text)}")
    if "@" in own and own[-1] == "a" and len(own) > 1 and own[-2] == ".":
        out.append("host")
    return out


def candidates(tokens: list[str], classes: list[str], first: int = 0, end: int | None = None) -> list[Span]:
    """Segments that may be an entity: of bounded length, with a digit or an at-sign, from and to a sensible token; those that begin from first up to end."""
    out = []
    n = len(tokens)
    for i in range(first, n if end is None else min(n, end)):
        if classes[i] not in ("9", "a", "+", "(", "["):
            continue
        marked, spaces = False, 0
        for j in range(i, min(n, i + ENTITY_TOKENS)):
            c = classes[j]
            if c == "_":
                spaces += 1
                if "\n" in tokens[j] or spaces > 5:
                    break
            marked = marked or c in ("9", "@")
            if marked and c in ("9", "a"):
                out.append((i, j + 1))
    return out


@dataclass
class Lattice:
    """A window's segments with their features; by the token at which they end."""

    n: int
    spans: list[Span]
    features: list[list[str]]
    single: list[list[str]]

    @staticmethod
    def of(tokens: list[str]) -> Lattice:
        classes = [_class(t) for t in tokens]
        spans = candidates(tokens, classes)
        return Lattice(len(tokens), spans, [span_features(tokens, classes, i, j) for i, j in spans], [[f"token {c}", f"token {c} {min(len(t), 6)}"] for t, c in zip(tokens, classes)])


@dataclass
class SemiMarkov:
    """Weights of (feature, kind), and of features of tokens outside. A last row of zeros stands for all unknown features."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, len(KINDS) + 1)))

    def ids(self, each: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the weights of all features, and where each list of them begins."""
        get, unknown = self.index.get, len(self.index)
        return np.array([get(f, unknown) for fs in each for f in fs], np.int64), np.cumsum([0, *map(len, each)])[:-1]

    def summed(self, ids: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        rows, starts = ids
        return np.add.reduceat(self.weights[rows], starts) if len(starts) else self.weights[:0]

    def scores(self, x: Lattice) -> tuple[np.ndarray, np.ndarray]:
        """Of each span for each kind, and of each token outside."""
        return self.summed(self.ids(x.features))[:, 1:], self.summed(self.ids(x.single))[:, 0]

    def best(self, x: Lattice) -> list[tuple[int, int, str, float]]:
        """The best segmentation's entities (first, last, kind, gain over leaving the tokens outside)."""
        s, o = self.scores(x)
        outside = np.concatenate([[0.0], np.cumsum(o)])
        kind = s.argmax(1) if len(s) else []
        value, back = [0.0], [(-1, -1)]
        ends: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(x.spans):
            ends.setdefault(j, []).append(k)
        for j in range(1, x.n + 1):
            v, b = value[j - 1] + o[j - 1], (j - 1, -1)
            for k in ends.get(j, ()):
                i = x.spans[k][0]
                if (w := value[i] + s[k, kind[k]]) > v:
                    v, b = w, (i, k)
            value.append(v)
            back.append(b)
        out, j = [], x.n
        while j:
            i, k = back[j]
            if k >= 0:
                out.append((i, j, KINDS[kind[k]], float(s[k, kind[k]] - outside[j] + outside[i])))
            j = i
        return out[::-1]

    def decode(self, tokens: list[str]) -> list[tuple[int, int, str, float]]:
        """As best, for any number of tokens: the features of WINDOW_TOKENS first tokens are held at a time, the values go on."""
        n = len(tokens)
        classes = [_class(t) for t in tokens]
        value, back, outside = [0.0] + [-np.inf] * n, [(-1, -1, 0.0)] * (n + 1), [0.0]
        for at in range(0, n, WINDOW_TOKENS):
            end = min(n, at + WINDOW_TOKENS)
            spans = candidates(tokens, classes, at, end)
            part = Lattice(end - at, spans, [span_features(tokens, classes, i, j) for i, j in spans], [[f"token {c}", f"token {c} {min(len(t), 6)}"] for t, c in zip(tokens[at:end], classes[at:end])])
            s, o = self.scores(part)
            k = 0
            for i in range(at, end):  # nothing leads to i any more, so its value is final
                if (v := value[i] + o[i - at]) >= value[i + 1]:
                    value[i + 1], back[i + 1] = v, (i, -1, 0.0)
                outside.append(outside[-1] + o[i - at])
                while k < len(spans) and spans[k][0] == i:
                    own = int(s[k].argmax())
                    if (v := value[i] + s[k, own]) > value[j := spans[k][1]]:
                        value[j], back[j] = v, (i, own, float(s[k, own]))
                    k += 1
        out, j = [], n
        while j:
            i, own, score = back[j]
            if own >= 0:
                out.append((i, j, KINDS[own], float(score - outside[j] + outside[i])))
            j = i
        return out[::-1]


def _marginals(x: Lattice, s: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each (span, kind) and of each token outside, by sums forwards and backwards."""
    n = x.n
    a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    a[0] = b[n] = 0.0
    total = np.logaddexp.reduce(s, axis=1) if len(s) else np.zeros(0)
    first, last = np.array([i for i, _ in x.spans], int), np.array([j for _, j in x.spans], int)
    for j in range(1, n + 1):
        own = np.flatnonzero(last == j)
        a[j] = np.logaddexp.reduce(np.append(a[first[own]] + total[own], a[j - 1] + o[j - 1]))
    for i in range(n - 1, -1, -1):
        own = np.flatnonzero(first == i)
        b[i] = np.logaddexp.reduce(np.append(b[last[own]] + total[own], b[i + 1] + o[i]))
    return np.exp(a[first][:, None] + s + b[last][:, None] - a[n]) if len(s) else s, np.exp(a[:n] + o + b[1:] - a[n])


def train(examples: list[tuple[list[str], list[tuple[int, int, str]]]], rounds: int = ROUNDS) -> SemiMarkov:
    """Weights by the gradient of the conditional likelihood, in steps that adapt to each weight. examples: tokens, entities."""
    lattices = [(Lattice.of(t), e) for t, e in examples]
    names = sorted({f for x, _ in lattices for fs in (*x.features, *x.single) for f in fs})
    model = SemiMarkov({f: k for k, f in enumerate(names)}, np.zeros((len(names) + 1, len(KINDS) + 1)))
    known = [(model.ids(x.features), model.ids(x.single)) for x, _ in lattices]
    seen = np.full_like(model.weights, 1e-2)
    for _ in range(rounds):
        for (x, entities), (of_span, of_token) in zip(lattices, known):
            s, o = model.summed(of_span)[:, 1:], model.summed(of_token)[:, 0]
            p, q = _marginals(x, s, o)
            at = {span: k for k, span in enumerate(x.spans)}
            outside = np.ones(x.n)
            more = -p
            for i, j, kind in entities:
                if (k := at.get((i, j))) is not None:
                    more[k, KINDS.index(kind)] += 1
                    outside[i:j] = 0
            rows = np.unique(np.concatenate([of_span[0], of_token[0]]))
            g = -1e-3 * model.weights[rows]
            for (ids, starts), own, cols in ((of_span, more, slice(1, None)), (of_token, (outside - q)[:, None], slice(0, 1))):
                each = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
                np.add.at(g[:, cols], np.searchsorted(rows, ids), own[each])
            seen[rows] += g * g
            model.weights[rows] += 0.5 * g / np.sqrt(seen[rows])
    return model


def _labelled(tokens: list[str], at: int, base: dict[str, list[Span]]) -> list[tuple[int, int, str]]:
    """Base spans of a window as entities over its tokens; of overlapping ones the first by kind."""
    edges = {at: 0}
    for k, t in enumerate(tokens):
        at += len(t)
        edges[at] = k + 1
    out: list[tuple[int, int, str]] = []
    for kind in KINDS:
        for a, b in base[kind]:
            i, j = edges.get(a), edges.get(b)
            if i is not None and j is not None and all(j <= x or i >= y for x, y, _ in out):
                out.append((i, j, kind))
    return sorted(out)


def _cropped(tokens: list[str], entities: list[tuple[int, int, str]], i: int, j: int) -> tuple[list[str], list[tuple[int, int, str]]]:
    """The tokens around those from i to j, without a part of any other entity."""
    a, b = max(0, i - MARGIN), min(len(tokens), j + MARGIN)
    for x, y, _ in entities:
        if x < a < y:
            a = y
        if x < b < y:
            b = x
    return tokens[a:b], [(x - a, y - a, k) for x, y, k in entities if x >= a and y <= b]


def _joined(parts: list[str], *marks: list[str]) -> list[str]:
    """Parts with marks between, the last of them again and again."""
    out = [parts[0]]
    for k, p in enumerate(parts[1:]):
        out += [*marks[min(k, len(marks) - 1)], p]
    return out


def _forms(own: list[str], kind: str) -> list[list[str]]:
    """Other ways to write an entity."""
    if kind == "phone":
        digits = "".join(t for t in own if t.isdigit())
        out = [own[1:]]
        if len(digits) >= 11:
            country, rest = digits[:-10], [digits[-10:-7], digits[-7:-4], digits[-4:]]
            bracketed = ["(", rest[0], ")"]
            out += [_joined(rest, [m]) for m in "-. "] + [[*bracketed, " ", *_joined(rest[1:], ["-"])], [*bracketed, *_joined(rest[1:], ["-"])]]
            out += [_joined([country, *rest], ["-"]), ["00" + country, " ", *_joined(rest, [" "])]]
        return out
    if kind == "email":
        local, domain = "".join(own).split("@")
        plain = [_TOKEN.findall(f"{x}@{y}") for x in (re.sub("[._-]?[0-9]+", "", local) or "me", re.sub("[0-9]+", "lee", local)) for y in (domain, re.sub("(?<=[A-Za-z])[0-9]+", "", domain))]
        forms = [("( at )", "."), ("_ at _", "."), ("[ at ]", "."), ("_ at _", "_ dot _"), ("( at )", "( dot )"), ("[ at ]", "[ dot ]"), ("_ ( at ) _", ".")]
        out = []
        for own, (a, d) in itertools.product([own, *plain], forms):
            a, d = ([" " if x == "_" else x for x in m.split(" ")] for m in (a, d))
            out.append([y for k, t in enumerate(own) for y in (a if t == "@" else d if t == "." and k > own.index("@") else [t])])
        return out
    if kind == "card":
        digits = "".join(t for t in own if t.isdigit())
        four = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return [_joined(four, ["."]), _joined(four, [" ", "-", " "]), _joined(four, ["/"])]
    four = [t for t in own if t.isdigit()]
    return [_joined(four, ["[", ".", "]"]), _joined(four, ["."], ["."], ["[", ".", "]"])]


def _others(r: random.Random) -> list[list[str]]:
    """What has digits, dots or a word like "at" and is no entity."""
    n = lambda a, b: str(r.randint(a, b))
    two = lambda b: f"{r.randint(1, b):02d}"
    return [
        [n(1900, 2100), "-", two(12), "-", two(28)], [two(28), ".", two(12), ".", n(1900, 2100)], [two(12), "/", two(28), "/", n(1900, 2100)], [two(23), ":", two(59), ":", two(59)], [n(1, 9), ".", n(0, 20), ".", n(0, 20)], [n(1900, 2000), "-", n(2001, 2100)],
        [n(1, 999), ",", n(100, 999), ",", n(100, 999)], [n(0, 999), ".", n(0, 99)], ["978", "-", n(1, 9), "-", n(10, 99), "-", n(100000, 999999), "-", n(0, 9)], [n(10**4, 10**9)], [n(10**11, 10**14)], ["seen", " ", "at", " ", "noon"], ["look", " ", "at", " ", "this", ".", "then"], ["at", " ", n(1, 24)],
    ]


def _variants(tokens: list[str], entities: list[tuple[int, int, str]], seed: int) -> Iterator[tuple[list[str], list[tuple[int, int, str]]]]:
    """What surrounds the window's first entity, with other forms of it, and with what is none."""
    if not entities:
        return
    tokens, entities = _cropped(tokens, entities, *entities[0][:2])
    i, j, kind = entities[0]
    r = random.Random(seed)
    forms, others = _forms(tokens[i:j], kind), _others(r)
    for own, marked in [*((x, True) for x in r.sample(forms, min(FORMS, len(forms)))), *((x, False) for x in r.sample(others, FORMS // 2))]:
        shift = len(own) - (j - i)
        yield tokens[:i] + own + tokens[j:], [(i, i + len(own), kind)] * marked + [(a + shift, b + shift, k) for a, b, k in entities[1:]]


#: Whether a text may hold a kind, as Spark tests it; the rest of a pattern's conditions are tested where windows are made.
_MAY = {"email": "@[A-Za-z0-9-]+\\.", "ip": "[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]", "card": "[0-9]([ -]?[0-9]){15}", "phone": "\\+[0-9]", "none": "[0-9]"}


def _whole(base: dict[str, list[Span]], at: int, end: int) -> bool:
    """Whether no base span is cut by the ends of a window."""
    return all(b <= at or a >= end or (a >= at and b <= end) for spans in base.values() for a, b in spans)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> SemiMarkov:
    """A model from at most SAMPLE_DOCS texts that may hold each kind and as many with other digits, in the order of a hash.

    Each is read whole, where it lies; at most DOC_WINDOWS of its windows of each kind, in the order of a
    hash, come to the driver. Of all these at most SAMPLE_WINDOWS of each kind and twice as many without an
    entity are used. Without any such text the model is empty and adds nothing. Null and empty texts teach
    nothing, texts that repeat teach once, and ids play no part.
    """
    named = docs.select(F.xxhash64(text).alias("k"), F.col(text).alias("t"))
    kinds = F.filter(F.array(*(F.when(F.col("t").rlike(p), F.lit(k)) for k, p in _MAY.items())), lambda x: x.isNotNull())
    flagged = materialise(named.select("k", kinds.alias("kinds")).where(F.size("kinds") > 0), "flagged").select("k", F.explode("kinds").alias("kind"))
    # hashes are spread evenly, so the least SAMPLE_DOCS of n lie below a bound that some 4 * SAMPLE_DOCS do
    below = {r.kind: min((1 << 64) - 1, (4 * SAMPLE_DOCS << 64) // max(1, r.n)) - (1 << 63) for r in flagged.groupBy("kind").agg(F.approx_count_distinct("k").alias("n")).collect()}
    if not below:
        return SemiMarkov()
    least = reduce(or_, ((F.col("kind") == kind) & (F.col("k") <= bound) for kind, bound in below.items()))
    rows = flagged.where(least).distinct().collect()
    ids = sorted({k for kind in below for k in sorted(r.k for r in rows if r.kind == kind)[:SAMPLE_DOCS]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                base, of = base_spans(t), {}
                for at, tokens in windows(t):
                    if _whole(base, at, at + sum(map(len, tokens))):
                        entities = _labelled(tokens, at, base)
                        said = json.dumps([tokens, entities])
                        for k in {k for *_, k in entities} or {None}:
                            of.setdefault(k, set()).add((hashlib.md5(said.encode()).hexdigest(), said))
                out += sorted({x for found in of.values() for x in sorted(found)[:DOC_WINDOWS]})
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 2, names=["h", "said"])

    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "k long")
    found = named.join(F.broadcast(chosen), "k").select("t").mapInArrow(run, "h string, said string").distinct().collect()  # windows of a bounded number of texts
    examples, taken = [], dict.fromkeys((*KINDS, None), 0)
    for h, said in sorted(map(tuple, found)):
        tokens, entities = json.loads(said)
        entities = [tuple(e) for e in entities]
        own = {k for *_, k in entities} or {None}
        if min(taken[k] / (2 if k is None else 1) for k in own) < SAMPLE_WINDOWS:
            for k in own:
                taken[k] += 1
            examples += [(tokens, entities), *_variants(tokens, entities, int(h[:8], 16))]
    return train(examples)


def find(text: str | None, model: SemiMarkov | None = None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and all spans: those the model adds overlap no base span. Null counts as empty."""
    text = text or ""
    base = base_spans(text)
    if model is None or not model.index:
        return base, base
    taken = sorted(s for spans in base.values() for s in spans)
    more: dict[str, list[Span]] = {k: [] for k in KINDS}
    for at, tokens in stretches(text):
        ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]) + at
        for i, j, kind, gain in model.decode(tokens):
            a, b = int(ends[i]), int(ends[j])
            if gain >= MIN_GAIN and all(b <= x or a >= y for x, y in taken):
                more[kind].append((a, b))
    return base, {k: sorted(base[k] + more[k]) for k in KINDS}


def written(spans: dict[str, list[Span]]) -> str:
    """kind:start:end, by kind and then start, with commas between."""
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def mask(text: str | None, spans: dict[str, list[Span]]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping ones become one, of the first kind."""
    out, end = [], 0
    for a, b, kind in sorted((a, -b, k) for k in KINDS for a, b in spans[k]):
        b = -b
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return text if not out else "".join(out) + text[end:]


def detect(docs: DataFrame, model: SemiMarkov, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all spans as text.

    A null or empty text has none: zeros and the digest of nothing. Texts are read whole, whatever their
    length. Of base spans of two kinds that overlap both stay. Repeated rows stay; an empty table gives
    none; other columns of docs play no part.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                base, spans = find(x.as_py(), held.value)
                out.append((*(len(base[k]) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            cols = [*zip(*out)] or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return bounded(docs.select(doc_id, text)).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask_documents(docs: DataFrame, model: SemiMarkov, text: str = "text") -> DataFrame:
    """docs with all spans masked in the text; rows and columns, whatever their names, stay, and so does a null or empty text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [mask(t, find(t, held.value)[1]) if t else t for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text else b.column(n) for n in b.schema.names], names=b.schema.names)

    return bounded(docs).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return detect(docs, fit(docs))
