"""Personal data by rules and by a semi-Markov conditional random field over whole spans.

Base spans are found by rule, leftmost and non-overlapping for each kind: email; ip (four numbers of at most 255); card
(16 to 19 digits that pass Luhn); phone (a plus sign, 8 to 15 digits). What fails its test is dropped, without another try.
They are always reported. Each rule takes time linear in the text.

The field adds spans that rules miss (an address without its last part, a phone number without a plus sign). A
text is cut into islands: runs of pieces without white space that hold a digit or @, one space apart. Everywhere
else no candidate can lie, so leaving islands out changes no result. Tokens are runs of letters and digits, and
single other characters. A candidate is a run of at most MOST_TOKENS tokens and MOST_CHARS characters that starts with a
letter, digit, + or ( and ends with a letter or digit, and holds @ or four digits. Its features are of the whole
span: number and lengths of its groups of digits, its separators, how it starts and ends, checks, its neighbours. A
segmentation of an island scores the sum of its spans' weights (a token outside scores 0); dynamic programming over
spans of bounded length chooses boundaries and types at once. Of the best segmentation, spans of a score of at least MARGIN
that touch no base span are added.

Learning: there are no labels of personal data, so base spans are the labels, and what rules miss is taught by
altered(): each base span also in other ways of writing it, and its digits as dates, amounts, versions and numbers that are
none. Conditional likelihood is raised by AdaGrad over exact forward-backward sums, on at most MAX_ISLANDS
islands of up to MAX_LEARNT tokens with a base span and as many without (those of the smallest hashes), each
distinct island once. Everything else covers all data.

Defined cases: a null text is empty and has no spans. Repeated rows are reported each. A null doc_id is an id like any other.
A very long text is handled whole by one task, in time that grows with its length. Base spans have any length;
added ones are bounded as above. Ties between segmentations go to the one that leaves a token out, then to the shorter
last span, then to the kind listed first. Extra columns, whatever their names, are not read. An
empty table gives no rows; without any base span in the table nothing is learnt and nothing added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS, MOST_CHARS = 16, 96
#: Log-odds over leaving its tokens out that an added span must have.
MARGIN = 2.0
MAX_ISLANDS, MAX_LEARNT, STEPS, RATE, DECAY = 600, 40, 120, 0.5, 1e-4

_AT = re.compile("@")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does, as all starts within a run fail or succeed together.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
#: Rows that hold none of these have no span; so most texts are passed over at the speed of a search.
_ANY = re.compile(rb"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _byte(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) < 4 and int(short or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    found, last = [], 0
    for m in _AT.finditer(text):
        at = start = m.start()
        if at < last:
            continue
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            last = domain.end()
            found.append((0, start, last))
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


# An island: pieces with a digit or @, one space apart. The possessive parts keep it linear in runs of any length.
_PIECE = r"[^\s0-9@]*+[0-9@]\S*+"
_ISLAND = re.compile(rf"(?<!\S){_PIECE}(?: {_PIECE})*")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def islands(text: str) -> Iterator[re.Match]:
    return _ISLAND.finditer(text)


def _length(n: int) -> str:
    return str(n) if n < 20 else "20+"


def _around(c: str) -> str:
    return "space" if not c or c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c if c.isascii() else "other"


@lru_cache(200_000)
def _inner(span: str) -> tuple[str, ...] | None:
    """Features of a candidate's own characters; None if it can't be one."""
    groups = re.findall("[0-9]+", span)
    n = sum(map(len, groups))
    ats = span.count("@")
    if not ats and n < 4:
        return None
    letters = sum(c.isalpha() for c in span)
    separators = "".join(sorted(set(re.sub(r"[^\W_]", "", span))))
    out = [
        "bias", f"digits {_length(n)}", f"groups {_length(len(groups))}", f"separators {separators}", f"at {min(ats, 2)}", f"letters {min(letters, 3)}",
        "first " + ("digit" if span[0].isdigit() else "letter" if span[0].isalpha() else span[0]), "last " + ("digit" if span[-1].isdigit() else "letter"),
        f"longest group {_length(max(map(len, groups), default=0))}", f"last group {_length(len(groups[-1]) if groups else 0)}",
    ]
    if not letters:
        out += [f"all digits {_length(n)}", f"sizes {separators} {'-'.join(str(len(g)) for g in groups[:6])}"]
        if 13 <= n <= 19:
            out.append(f"luhn {luhn(''.join(groups))}")
        if span.count(".") == len(groups) - 1:
            out.append(f"dotted {len(groups)} {all(map(_byte, groups))}")
    if ats == 1:
        left, right = span.split("@")
        out += [f"left part {bool(left)}", f"right dots {min(right.count('.'), 3)}", f"right ends {'letter' if right[-1:].isalpha() else 'digit'}"]
    return tuple(out)


def candidates(text: str, begin: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, tuple[str, ...]]]]:
    """Tokens of an island and its candidates (first token, token after the last, features)."""
    tokens = [m.span() for m in _TOKEN.finditer(text, begin, end)]
    found = []
    starts = [i for i, (s, _) in enumerate(tokens) if text[s].isalnum() or text[s] in "+("]
    ends = [text[e - 1].isalnum() for _, e in tokens]
    for i in starts:
        s = tokens[i][0]
        left = _around(text[s - 1 : s])
        for j in range(i, min(len(tokens), i + MOST_TOKENS)):
            e = tokens[j][1]
            if e - s > MOST_CHARS:
                break
            if ends[j] and (own := _inner(text[s:e])) is not None:
                found.append((i, j + 1, (*own, f"before {left}", f"after {_around(text[e : e + 1])}", f"tokens {j + 1 - i}")))
    return tokens, found


def best_segments(n: int, scored: list[tuple[int, int, list[float]]]) -> list[tuple[int, int, int, float]]:
    """(first token, token after the last, kind, score) of the best segmentation of n tokens."""
    ending: dict[int, list] = {}
    for i, j, scores in scored:
        kind = max(range(len(KINDS)), key=scores.__getitem__)
        if scores[kind] > 0:
            ending.setdefault(j, []).append((i, kind, scores[kind]))
    if not ending:
        return []
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, kind, score in sorted(ending.get(j, ()), key=lambda x: -x[0]):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, j, kind, score)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            out.append(back[j])
            j = back[j][0]
    return out[::-1]


class Field:
    """Weights of (feature, kind)."""

    def __init__(self, weights: dict[str, list[float]]):
        self.weights = weights
        self.zero = [0.0] * len(KINDS)

    def score(self, features: tuple[str, ...]) -> list[float]:
        get, zero = self.weights.get, self.zero
        return [sum(x) for x in zip(*(get(f, zero) for f in features), strict=True)]

    def added(self, text: str, base: list[tuple[int, int, int]], margin: float = MARGIN) -> list[tuple[int, int, int]]:
        taken = sorted((s, e) for _, s, e in base)
        starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        out = []
        for island in islands(text):
            tokens, found = candidates(text, *island.span())
            for i, j, kind, score in best_segments(len(tokens), [(i, j, self.score(f)) for i, j, f in found]):
                start, end = tokens[i][0], tokens[j - 1][1]
                before = bisect_left(starts, end)
                if score >= margin and not (before and reach[before - 1] > start):
                    out.append((kind, start, end))
        return out


def altered(span: str, kind: int) -> list[tuple[str, bool]]:
    """Other texts made of a base span, and whether they are still of its kind."""
    d = _NOT_DIGIT.sub("", span)
    if kind == 0:
        name, domain = span.split("@")
        labels = domain.split(".")
        return [(f"{name}@{'.'.join(labels[:n])}", True) for n in range(1, len(labels))] + [("@" + name, False), (f"{name}@", False)]
    if kind == 1:
        parts = span.split(".")
        return [(".".join([*parts[:3], str(256 + int(parts[3]) % 256)]), False), (".".join(parts[:3]), False), (",".join(parts), False), (d, False)]
    if kind == 2:
        fours = [d[i : i + 4] for i in range(0, len(d), 4)]
        wrong = d[:-1] + str((int(d[-1]) + 1) % 10)
        return [(".".join(fours), True), ("/".join(fours), True), (wrong, False), (" ".join(wrong[i : i + 4] for i in range(0, len(d), 4)), False), (d[:10], False), (hashlib.sha256(d.encode()).hexdigest()[:32], False)]
    dates = [f"{d[:4]}-{d[4:6]}-{d[6:8]}", f"{d[:2]}/{d[2:4]}/{d[4:8]}", f"{d[:4]}-{d[4:6]}-{d[6:8]} {d[1:3]}:{d[2:4]}:{d[3:5]}", f"{d[0]},{d[1:4]},{d[4:7]}.{d[6:8]}", f"{d[:4]}.{d[4:6]}", f"{d[0]}.{d[1:3]}.{d[3:8]}.{d[7]}", f"{d[:4]}-{d[4:8]}", f"{d[:3]}-{d[3:6]}-{d[-4:]}-{d[:4]}", d[:8], d]
    if len(d) < 10:
        return [(x, False) for x in dates]
    area, exchange, line = d[-10:-7], d[-7:-4], d[-4:]
    return [(f"({area}) {exchange}-{line}", True), (f"{area}-{exchange}-{line}", True), (f"{area}.{exchange}.{line}", True)] + [(x, False) for x in dates]


def examples_of(pieces: list[str]) -> list[tuple[int, list, list]]:
    """Training examples of islands, and of the altered forms of their base spans."""
    out = []
    for piece in pieces:
        base = base_spans(piece)
        shown = [(piece, None)]
        for kind, s, e in base:
            if e - s <= MOST_CHARS:
                shown += [(text, kind if still else -1) for text, still in altered(piece[s:e], kind)]
        for text, kind in shown:
            tokens, found = candidates(text, 0, len(text))
            if found and len(tokens) <= MAX_LEARNT:
                spans = base if kind is None else [] if kind < 0 else [(kind, 0, len(text))]
                out.append((len(tokens), found, _gold(tokens, spans, found)))
    return out


def learn(examples: list[tuple[int, list[tuple[int, int, tuple[str, ...]]], list[tuple[int, int, int]]]], steps: int = STEPS) -> Field:
    """Examples are (tokens, candidates, gold (first token, token after the last, kind)) of islands; equal ones count as often as they come."""
    times = Counter((n, tuple(found), tuple(gold)) for n, found, gold in examples)
    examples = sorted(times)
    times = np.array([times[x] for x in examples], float)
    names = {f: i for i, f in enumerate(sorted({f for _, found, _ in examples for _, _, fs in found for f in fs}))}
    features, sizes, gold_rows, gold_kinds, plans, weight, row = [], [], [], [], [], [], 0
    for (n, found, gold), many in zip(examples, times, strict=True):
        place = {}
        into: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for i, j, fs in found:
            features += [names[f] for f in fs]
            sizes.append(len(fs))
            weight.append(many)
            place[i, j] = row
            into[j].append((i, row))
            row += 1
        for i, j, kind in gold:
            gold_rows.append(place[i, j])
            gold_kinds.append(kind)
        plans.append((n, into))
    weights = np.zeros((len(names), len(KINDS)))
    squares = np.full_like(weights, 1e-8)
    features, owner = np.array(features), np.repeat(np.arange(row), sizes)
    truth = np.zeros((row, len(KINDS)))
    truth[gold_rows, gold_kinds] = 1
    for _ in range(steps):
        scores = np.zeros((row, len(KINDS)))
        for k in range(len(KINDS)):
            scores[:, k] = np.bincount(owner, weights[features, k], row)
        most = scores.max(1)
        joint = (most + np.log(np.exp(scores - most[:, None]).sum(1))).tolist()  # a span of any kind
        share = np.zeros(row)
        for n, into in plans:
            ahead = [0.0] * (n + 1)
            for j in range(1, n + 1):
                terms = [ahead[j - 1], *(ahead[i] + joint[r] for i, r in into[j])]
                top = max(terms)
                ahead[j] = top + np.log(sum(np.exp(t - top) for t in terms)) if len(terms) > 1 else top
            behind = [-np.inf] * (n + 1)
            behind[n] = 0.0
            for j in range(n, 0, -1):
                behind[j - 1] = np.logaddexp(behind[j - 1], behind[j])
                for i, r in into[j]:
                    share[r] = np.exp(ahead[i] + joint[r] + behind[j] - ahead[n])
                    behind[i] = np.logaddexp(behind[i], joint[r] + behind[j])
        expected = share[:, None] * np.exp(scores - np.array(joint)[:, None])
        gap = ((truth - expected) * np.array(weight)[:, None])[owner]
        gradient = np.stack([np.bincount(features, gap[:, k], len(names)) for k in range(len(KINDS))], 1) / times.sum() - DECAY * weights
        squares += gradient**2
        weights += RATE * gradient / np.sqrt(squares)
    return Field({name: weights[i].tolist() for name, i in names.items()})


def _gold(tokens: list[tuple[int, int]], base: list[tuple[int, int, int]], found: list) -> list[tuple[int, int, int]]:
    """Base spans as candidates, earlier and then longer ones first; those that are none are left out."""
    starts, ends = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
    known, out, last = {(i, j) for i, j, _ in found}, [], 0
    for kind, s, e in sorted(base, key=lambda x: (x[1], -x[2])):
        i, j = starts.get(s), ends.get(e)
        if (i, j) in known and i >= last:
            out.append((i, j, kind))
            last = j
    return out


def _sample(docs: DataFrame, text_col: str, most: int) -> list[str]:
    """Distinct islands by hash: up to `most` with base spans and `most` without."""

    def run(batches):
        kept: dict[bytes, tuple[str, bool]] = {}
        for batch in batches:
            for raw in texts(batch.column("text")):
                if not _ANY.search(raw):
                    continue
                for m in islands(text := raw.decode("utf-8", "replace")):
                    s, e = m.span()
                    if e - s <= MAX_LEARNT * MOST_CHARS:
                        piece = text[s:e]
                        kept[hashlib.sha256(piece.encode()).digest()[:16]] = piece, bool(base_spans(piece))
            kept = {h: kept[h] for has in (True, False) for h in sorted(h for h, x in kept.items() if x[1] is has)[:most]}
        rows = [(h, *x) for h, x in kept.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.string(), pa.bool_()))], names=["h", "piece", "has"])

    drawn = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "h binary, piece string, has boolean")
    # At most `most` rows of each sort leave a task, and in the end as many come to the driver.
    distinct = cut(drawn.distinct())
    return [r.piece for has in (True, False) for r in distinct.where(F.col("has") == has).orderBy("h").limit(most).collect()]


def fit(docs: DataFrame, text_col: str = "text", most: int = MAX_ISLANDS) -> Field | None:
    """The field that the base spans of docs teach; None if there are none."""
    examples = examples_of(_sample(docs, text_col, most))
    return learn(examples) if any(gold for _, _, gold in examples) else None


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        field = shared.value
        for batch in batches:
            counts, digests, spans, extra = [[] for _ in KINDS], [], [], []
            for raw in texts(batch.column("text")):
                base, more = [], []
                if _ANY.search(raw):
                    text = raw.decode("utf-8", "replace")
                    base = base_spans(text)
                    if field is not None:
                        more = field.added(text, base, margin)
                for k, column in enumerate(counts):
                    column.append(sum(b[0] == k for b in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest() if base else empty)
                spans.append(listed(sorted(base + more)))
                extra.append(len(more))
            arrays = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(extra, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
