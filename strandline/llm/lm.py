"""LM scoring by a log-bilinear model of classes and words, trained in numpy with noise-contrastive estimation.

Tokens are a text's words (A-Z lower-cased, runs outside [\\x20\\x09-\\x0D]), then one end. Learning
covers every row whose crc32(doc_id as text) mod 5 is not 1, whole texts.

base_score adds log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens, where c is the token's count, N of all
and V of distinct training tokens; n_known counts tokens with c > 0.

score is the model's log10 probability of the text. The WORDS most frequent words are the model's; the
others share one class, in which a word has its add-0.5 share. Words fall into CLASSES classes: the OWN
most frequent have one each, the others are clustered by their neighbours. With c a token's class, b the
token before and a the one before that,
  P(token | a, b) = P(c | group of a, b) x P(token | c, b).
Both factors are log-bilinear: the target's vector times the sum of the context's vectors, each of its
place, plus a bias. b has the vector of its class and, being one of the NEAR most frequent words, one of its own;
the factors are normalised over all classes, and over all words of the class. Matrix products
of all vectors give the scores and the normaliser of every context, so probabilities add up to 1 exactly.

Training: counts of (group, context, class) and of (context, word) are gathered from all training tokens,
where a context is one of the NEAR words or the class of another.
These tables are bounded by the parameters, and only the counts in them grow with the corpus. Nothing is drawn
from them: NCE passes over all contexts in turn (PASSES, WORD_PASSES times, in random order), and a context brings all
its counts at once, as true targets, and its noise in expectation over all targets. Passes are cut into a fixed number of
steps (STEPS, WORD_STEPS), so a longer corpus makes the counts better and the training no longer.
Class vectors: in each of ROUNDS rounds SLICES slices of the contexts, dealt by hash, take STEPS steps from the
common vectors and are averaged by count.
Word vectors: a word is normalised within its class only, so each of SLICES groups of classes learns its
own words, with context vectors of its own, and nothing has to be averaged. Slices and the rows in them
are ordered, so the result doesn't depend on the cluster.

Defined cases: a null text is empty and is one end token. Without training rows all counts are 0 and both
scores use N = V = 0. A null doc_id is not held out and not learned from. Repeated rows count and are
scored each. A very long text is handled whole by one task; a word of over LONGEST bytes is kept as its
128-bit hash. Ties between words are broken by hash, then bytes. Extra columns, whatever their names, are
not read. An empty table gives no rows.

Scale: counts are added up in tasks, then by Spark. At most HEAVY of the most frequent words are
broadcast: counts are taken in steps of a sixteenth of a doubling, and of the step that doesn't fit as
a whole, words by hash. All other words of a document are joined with the count table, and no word there
is frequent. Driver state is at most HEAVY words, WORDS vectors, and 2 (SEEDS + 1) counts of each of
WORDS words; none of it grows with the corpus beyond these bounds.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, cut, fold, texts

WORDS = 65_536
CLASSES = 256
OWN = 128
NEAR = 1024
GROUPS = 32
SEEDS = 32
WIDTH = 32
SLICES = 8
ROUNDS = 4
STEPS = 150
WORD_STEPS = 400
PASSES = 10
WORD_PASSES = 20
HEAVY = 150_000
LONGEST = 64
BINS = 1024
BLOCK = 32_768
CODES = 2_000_000
CELLS = 2_000_000


def words_of(text: bytes) -> list[bytes]:
    words = text.translate(LOWER_BYTES).split()
    if len(text) > LONGEST and max(map(len, words), default=0) > LONGEST:
        return [w if len(w) <= LONGEST else b" " + hashlib.md5(w).digest() for w in words]
    return words


def word_counts(train: DataFrame) -> DataFrame:
    """train: text. Returns word (binary), n, over all rows."""

    def run(batches):
        held: Counter = Counter()

        def out():
            words, counts = list(held), list(held.values())
            held.clear()
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.binary()), pa.array(counts[at : at + 50_000], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in texts(batch.column("text")):
                held.update(words_of(text))
                if len(held) > 400_000:
                    yield from out()
        yield from out()

    return train.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """The heavy words by falling count, those of the model first, and the totals of the count table."""

    def __init__(self, heavy: list[tuple[bytes, int]], tokens: int, kinds: int, docs: int, words: int):
        heavy = sorted(heavy, key=lambda x: (-x[1], x[0]))
        self.index = {w: i for i, (w, _) in enumerate(heavy)}
        self.counts = np.array([n for _, n in heavy], np.int64)
        self.docs, self.tokens, self.kinds = docs, tokens + docs, kinds + (docs > 0)
        self.words = min(len(heavy), words)
        self.rest, self.end, self.start = self.words, self.words + 1, self.words + 2
        self.size = self.words + 3
        self.rest_tokens, self.rest_kinds = tokens - int(self.counts[: self.words].sum()), kinds - self.words
        self.unigrams = np.concatenate((self.counts[: self.words], (self.rest_tokens, docs, 0))).astype(float)

    def base(self, count):
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))

    def in_rest(self, count):
        return np.log10((count + 0.5) / (self.rest_tokens + 0.5 * (self.rest_kinds + 1)))

    def find(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))

    def tokens_of(self, at: np.ndarray) -> np.ndarray:
        """The model's numbers of a text's tokens, the start before and the end after them."""
        return self.in_row(at, np.array([len(at)]))

    def in_row(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """tokens_of() texts of so many words each, one behind the other."""
        ids = np.empty(len(at) + 2 * len(sizes), np.int64)
        ends = np.cumsum(sizes + 2)
        inside = np.ones(len(ids), bool)
        inside[ends - 1] = inside[ends - sizes - 2] = False
        ids[inside] = np.where((at < 0) | (at >= self.words), self.rest, at)
        ids[ends - 1], ids[ends - sizes - 2] = self.end, self.start
        return ids


def blocks(bodies):
    """Lists of the words of some texts each: about BLOCK words, or one text."""
    held, size = [], 0
    for text in bodies:
        words = words_of(text)
        if held and size + len(words) > BLOCK:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def flat(held: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    return list(chain.from_iterable(held)), np.fromiter(map(len, held), np.int64, len(held))


def heavy_words(counts: DataFrame, most: int) -> Column:
    """Whether a word is one of the at most `most` broadcast ones."""
    step, part = F.floor(F.log2("n") * 16), F.pmod(F.xxhash64("word"), F.lit(BINS))
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    held, whole = 0, None
    for row in steps:
        if held + row["words"] > most:
            break
        held, whole = held + row["words"], row["step"]
    else:
        return F.lit(True)
    first = 0
    for b in counts.where(step == row["step"]).groupBy(part.alias("part")).agg(F.count("*").alias("words")).orderBy("part").collect():
        if held + b["words"] > most:
            break
        held, first = held + b["words"], b["part"] + 1
    split = (step == row["step"]) & (part < first)
    return split if whole is None else (step >= whole) | split


def lexicon(counts: DataFrame, docs: int, words: int, heavy: Column) -> Lexicon:
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = counts.where(heavy).select("word", "n").toArrow()
    return Lexicon(list(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True)), tokens, kinds, docs, words)


def code_counts(train: DataFrame, shared, codes_of) -> DataFrame:
    """code, n over all training tokens: codes_of(shared value, token numbers of texts) gives arrays of codes."""

    def run(batches):
        value = shared.value
        lexicon_ = value[0]
        fresh, held, code, n = [], 0, np.empty(0, np.int64), np.empty(0, np.int64)

        def merged():
            new = np.sort(np.concatenate(fresh))
            first = np.flatnonzero(np.diff(new, prepend=-1))
            both, times = np.concatenate((code, new[first])), np.concatenate((n, np.diff(first, append=len(new))))
            if not len(code):
                return both, times
            order = np.argsort(both, kind="stable")
            both = both[order]
            first = np.flatnonzero(np.diff(both, prepend=-1))
            return both[first], np.add.reduceat(times[order], first)

        def out():
            for at in range(0, len(code), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(code[at : at + 100_000]), pa.array(n[at : at + 100_000])], names=["code", "n"])

        for batch in batches:
            for some in blocks(texts(batch.column("text"))):
                words, sizes = flat(some)
                found = list(codes_of(value, lexicon_.in_row(lexicon_.find(words), sizes)))
                fresh += found
                held += sum(map(len, found))
                if held > CODES:
                    code, n = merged()
                    fresh, held = [], 0
                    if len(code) > 1_000_000:
                        yield from out()
                        code, n = code[:0], n[:0]
        if held:
            code, n = merged()
        yield from out()

    return train.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def neighbours(value, ids: np.ndarray):
    """Codes of a word and the seed before, and of a word and the seed after it, within texts."""
    seeds = SEEDS + 1
    seed, inside = np.minimum(ids, SEEDS), ids[1:] != value[0].start
    yield (ids[1:] * (2 * seeds) + seed[:-1])[inside]
    yield (ids[:-1] * (2 * seeds) + seeds + seed[1:])[inside]


def k_means(x: np.ndarray, weight: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """The cluster of each row of x, of at most k."""
    draw = np.random.default_rng(1)
    k = min(k, len(x))
    if k < 2:
        return np.zeros(len(x), np.int64)
    middle = x[draw.choice(len(x), k, replace=False, p=weight / weight.sum())].copy()
    for _ in range(turns):
        at = ((middle**2).sum(1) - 2 * x @ middle.T).argmin(1)
        total = np.bincount(at, weight, k)
        sums = np.stack([np.bincount(at, weight * column, k) for column in x.T], 1)
        middle[total > 0] = (sums / np.maximum(total, 1e-9)[:, None])[total > 0]
    return at


class Classes:
    """The class, and the group, of each of the model's tokens; members holds the tokens class by class."""

    def __init__(self, features: np.ndarray, unigrams: np.ndarray, classes: int, groups: int, own: int, near: int = NEAR):
        n = len(unigrams) - 3
        total = features.sum(0)
        smooth = features + 2 * total / max(total.sum(), 1)
        x = np.sqrt(smooth / np.maximum(smooth.sum(1, keepdims=True), 1e-9)).astype(np.float32)[:n]
        x -= x.mean(0) if n else 0
        weight = np.sqrt(unigrams[:n])
        own = min(own, n, classes - 4)
        self.of = np.concatenate((np.arange(own), own + k_means(x[own:], weight[own:], classes - 3 - own) if n > own else [], classes - 3 + np.arange(3))).astype(np.int64)
        self.group = np.concatenate((k_means(x, weight, groups - 3), groups - 3 + np.arange(3))).astype(np.int64)
        self.n, self.groups = classes, groups
        # As a context a token is a word of its own or, beyond the `near` most frequent words, its class.
        near = min(near, n)
        self.near, self.contexts = np.where(np.arange(n + 3) < near, np.arange(n + 3), near + self.of), near + classes
        # Every context also adds the vector of its class, which words that are seldom seen have to rely on.
        self.wider = np.concatenate((self.of[:near], np.arange(classes)))
        self.members = np.argsort(self.of, kind="stable")
        self.first = np.searchsorted(self.of[self.members], np.arange(classes + 1))
        self.size = np.diff(self.first)
        self.share = unigrams + 0.5
        self.share[-1] = 0.5
        self.total = np.bincount(self.of, self.share, classes)


def grouped(classes: Classes, start_: int, ids: np.ndarray):
    """Of each token of texts but the starts: its number, the token before it and the group of the one before that."""
    far = np.concatenate(([start_], ids[:-2]))
    far[ids[:-1] == start_] = start_
    inside = ids[1:] != start_
    return ids[1:][inside], ids[:-1][inside], classes.group[far[inside]]


def contexts(value, ids: np.ndarray):
    """Codes of (group, context, class), and, above them, of (context, word) for words that share their class."""
    lexicon_, classes = value
    word, before, group = grouped(classes, lexicon_.start, ids)
    c, k, before = classes.of[word], classes.n, classes.near[before]
    yield (group * classes.contexts + before) * k + c
    alike = classes.size[c] > 1
    yield classes.groups * classes.contexts * k + (before * lexicon_.size + word)[alike]


class Cells:
    """A table of counts by context, of rows sorted by context; each pass deals all contexts to steps."""

    def __init__(self, context: np.ndarray, target: np.ndarray, n: np.ndarray, steps: int, passes: int):
        self.contexts, first = np.unique(context, return_index=True)
        self.edges, self.target, self.n = np.append(first, len(context)), target, n.astype(np.float32)
        self.passes = min(passes, steps)
        self.parts = max(1, min(len(first), steps // max(1, self.passes)))
        self.mean = float(n.sum()) / self.parts

    def steps(self, draw):
        for _ in range(self.passes if len(self.contexts) else 0):
            yield from np.array_split(draw.permutation(len(self.contexts)), self.parts)

    def rows(self, own: np.ndarray):
        """Of each row of the given contexts: which of them it belongs to, its target and its count."""
        low, size = self.edges[own], np.diff(self.edges)[own]
        rows = np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)
        return np.repeat(np.arange(len(own)), size), self.target[rows], self.n[rows]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return (1 / (1 + np.exp(-np.clip(x, -30, 30)))).astype(np.float32)


class Ada:
    """Adagrad steps on some rows of an array."""

    def __init__(self, value: np.ndarray, rate: float, small: float):
        self.value, self.rate, self.squares = value.copy(), rate, np.full(value.shape, small, np.float32)

    def step(self, ids: np.ndarray, slopes: np.ndarray, size: int):
        """ids may repeat; their slopes add up."""
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.concatenate(([0], np.nonzero(np.diff(ids))[0] + 1))
        slope = np.add.reduceat(slopes[order], first) / np.float32(size)
        ids = ids[first]
        self.squares[ids] += slope**2
        self.value[ids] -= self.rate * slope / np.sqrt(self.squares[ids])

    def step_all(self, slopes: np.ndarray, size: float):
        slope = slopes / np.float32(size)
        self.squares += slope**2
        self.value -= self.rate * slope / np.sqrt(self.squares)


def start(shape: tuple, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 0.1, shape).astype(np.float32)


def class_parameters(classes: Classes, width: int) -> list[np.ndarray]:
    """Vectors of groups, of words (or classes) and of classes as contexts, of classes as targets, and biases."""
    return [start((classes.groups, width), 1), np.zeros((classes.contexts, width), np.float32), start((classes.n, width), 2), start((classes.n, width), 3), np.log((classes.total + 0.5) / (classes.total + 0.5).sum()).astype(np.float32)]


def class_nce(parameters: list[np.ndarray], classes: Classes, code: np.ndarray, n: np.ndarray, steps: int, seed: int, noise: int = 64, rate: float = 0.2) -> list[np.ndarray]:
    """The parameters after so many NCE steps, in whole passes over sorted rows of the class table."""
    draw = np.random.default_rng(seed)
    far, near, wider, out, bias = (Ada(x, rate, 1e-5) for x in parameters)
    k = classes.n
    expected = (noise * (classes.total + 0.5) / (classes.total + 0.5).sum()).astype(np.float32)
    cells = Cells(*np.divmod(code, k), n, steps, PASSES)
    for own in cells.steps(draw):
        g, b = np.divmod(cells.contexts[own], classes.contexts)
        at, t, times = cells.rows(own)
        wide = classes.wider[b]
        q = near.value[b] + wider.value[wide] + far.value[g]
        slope = sigmoid(q @ out.value.T + bias.value - np.log(expected))
        true = (slope[at, t] - 1) * times
        slope *= np.bincount(at, times, len(own)).astype(np.float32)[:, None] * expected
        slope[at, t] += true
        of_context = slope @ out.value
        out.step_all(slope.T @ q, cells.mean)
        bias.step_all(slope.sum(0), cells.mean)
        near.step(b, of_context, cells.mean)
        wider.step(wide, of_context, cells.mean)
        far.step(g, of_context, cells.mean)
    return [x.value for x in (far, near, wider, out, bias)]


def word_nce(classes: Classes, code: np.ndarray, n: np.ndarray, width: int, steps: int, seed: int, noise: int = 8, rate: float = 0.05) -> tuple[np.ndarray, ...]:
    """Tokens, their vectors, their biases and the context vectors after so many NCE steps, in whole passes over sorted (context, word) rows."""
    draw = np.random.default_rng(seed)
    before, word = np.divmod(code, len(classes.of))
    # The tokens of the slice's classes, class by class; noise is of a target's class.
    mine = np.isin(np.arange(classes.n), np.unique(classes.of[word]))
    tokens = classes.members[mine[classes.of[classes.members]]]
    place = np.zeros(len(classes.of), np.int64)
    place[tokens] = np.arange(len(tokens))
    sizes, of = classes.size[mine], (np.cumsum(mine) - 1)[classes.of[tokens]]
    log_share = np.log(classes.share[tokens] / classes.total[classes.of[tokens]]).astype(np.float32)
    expected = np.float32(noise) * np.exp(log_share)
    vectors, bias = Ada(start((len(classes.of), width), 4)[tokens], rate, 1e-7), Ada(log_share, rate, 1e-7)
    context, wider = Ada(np.zeros((classes.contexts, width), np.float32), rate, 1e-7), Ada(start((classes.n, width), 5), rate, 1e-7)
    cells, most = Cells(before, place[word], n, steps, WORD_PASSES), max(1, CELLS // max(1, len(tokens)))
    for own in cells.steps(draw):
        b = cells.contexts[own]
        wide = classes.wider[b]
        q, of_context = context.value[b] + wider.value[wide], np.empty((len(own), width), np.float32)
        of_vectors, of_bias = np.zeros_like(vectors.value), np.zeros_like(bias.value)
        # A step may hold all contexts, and a slice nearly all words: some contexts at a time.
        for low in range(0, len(own), most):
            part = slice(low, low + most)
            at, t, times = cells.rows(own[part])
            slope = sigmoid(q[part] @ vectors.value.T + bias.value - np.log(expected))
            true = (slope[at, t] - 1) * times
            totals = np.bincount(at * len(sizes) + of[t], times, len(slope) * len(sizes)).astype(np.float32)
            slope *= np.repeat(totals.reshape(len(slope), -1), sizes, axis=1)
            slope *= expected
            slope[at, t] += true
            of_context[part] = slope @ vectors.value
            of_vectors += slope.T @ q[part]
            of_bias += slope.sum(0)
        vectors.step_all(of_vectors, cells.mean)
        bias.step_all(of_bias, cells.mean)
        context.step(b, of_context, cells.mean)
        wider.step(wide, of_context, cells.mean)
    return tokens, vectors.value, bias.value, context.value + wider.value[classes.wider]


class Model:
    """Scores and normalisers of all contexts, in natural logs, by matrix products."""

    def __init__(self, classes: Classes, class_level: list[np.ndarray], word_level: list[tuple[int, tuple[np.ndarray, ...]]], width: int):
        far, near, wider, out, bias = class_level
        near = near + wider[classes.wider]
        k, size = classes.n, len(classes.of)
        self.classes = classes
        # A class without tokens, the start among them, is no target.
        allowed = np.where((classes.size > 0) & (np.arange(k) != k - 1), 0, -np.inf)
        self.near = near @ out.T + bias + allowed
        self.far = far @ out.T
        self.norm = np.stack([_log_sum(self.near + f) for f in self.far])
        self.vectors = np.zeros((size, width), np.float32)
        self.bias = np.log(classes.share / classes.total[classes.of])
        self.context = np.zeros((SLICES, classes.contexts, width), np.float32)
        for part, (tokens, vectors, biases, context) in word_level:
            self.vectors[tokens], self.bias[tokens], self.context[part] = vectors, biases, context
        self.word_norm = np.zeros((classes.contexts, k))
        for c in range(k):
            own = classes.members[classes.first[c] : classes.first[c + 1]]
            # A class may hold nearly all words: some contexts at a time.
            step = max(1, 2_000_000 // max(1, len(own)))
            for at in range(0, classes.contexts if len(own) else 0, step):
                self.word_norm[at : at + step, c] = _log_sum(self.context[c % SLICES, at : at + step] @ self.vectors[own].T + self.bias[own])

    def log_probability(self, ids: np.ndarray) -> np.ndarray:
        """Of each token of texts but the starts, in natural logs; for the shared class that of the class."""
        word, before, group = grouped(self.classes, len(self.classes.of) - 1, ids)
        out = np.empty(len(word))
        for at in range(0, len(word), 8192):
            w, b, g = word[at : at + 8192], self.classes.near[before[at : at + 8192]], group[at : at + 8192]
            t = self.classes.of[w]
            by_word = np.einsum("ij,ij->i", self.context[t % SLICES, b], self.vectors[w]) + self.bias[w] - self.word_norm[b, t]
            out[at : at + 8192] = self.near[b, t] + self.far[g, t] - self.norm[g, b] + by_word
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def trained(counts: DataFrame, shared, size: int, rounds: int = ROUNDS, steps: int = STEPS, word_steps: int = WORD_STEPS, width: int = WIDTH) -> Model:
    """counts: code, n of contexts(), a written table; shared: a broadcast of (Lexicon, Classes), size the model's tokens."""
    _, classes = shared.value
    context = counts.sparkSession.sparkContext
    cells = classes.groups * classes.contexts * classes.n
    # Codes of one slice, with whole contexts, are one group: a bounded part of a bounded table. By ranges, so that slices run side by side.
    table = counts.where(F.col("code") < cells).withColumn("slice", F.pmod(F.xxhash64(F.floor(F.col("code") / classes.n)), F.lit(SLICES)).cast("int")).repartitionByRange(4 * SLICES, "slice")
    parameters = class_parameters(classes, width)

    def one_round(given, turn):
        def run(key, rows):
            rows = rows.sort_by("code")
            n = rows["n"].to_numpy()
            done = class_nce(given.value, shared.value[1], rows["code"].to_numpy(), n, steps, SLICES * turn + key[0].as_py())
            return pa.table({"n": [float(n.sum())], "parameters": pa.array([np.concatenate([x.ravel() for x in done]).astype(np.float32).tobytes()], pa.binary())})

        return run

    for turn in range(rounds):
        done = sorted(table.groupBy("slice").applyInArrow(one_round(context.broadcast(parameters), turn), "n double, parameters binary").collect())
        if not done:
            break
        flat = sum(n * np.frombuffer(x, np.float32).astype(float) for n, x in done) / sum(n for n, _ in done)
        edges = np.cumsum([x.size for x in parameters])[:-1]
        parameters = [part.reshape(x.shape).astype(np.float32) for part, x in zip(np.split(flat, edges), parameters, strict=True)]

    of = context.broadcast(classes.of % SLICES)

    def own_words(key, rows):
        rows = rows.sort_by("code")
        done = word_nce(shared.value[1], rows["code"].to_numpy(), rows["n"].to_numpy(), width, word_steps, key[0].as_py())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), **{name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("tokens", "vectors", "bias", "context"), done, strict=True)}})

    def sliced(batches):
        for batch in batches:
            code = batch.column("code").to_numpy() - cells
            yield pa.RecordBatch.from_arrays([pa.array(of.value[code % size].astype(np.int32)), pa.array(code), batch.column("n")], names=["slice", "code", "n"])

    words = counts.where(F.col("code") >= cells).mapInArrow(sliced, "slice int, code long, n long").repartitionByRange(4 * SLICES, "slice")
    level = []
    for row in words.groupBy("slice").applyInArrow(own_words, "slice int, tokens binary, vectors binary, bias binary, context binary").collect():
        tokens = np.frombuffer(row["tokens"], np.int64)
        level.append((row["slice"], (tokens, np.frombuffer(row["vectors"], np.float32).reshape(len(tokens), width), np.frombuffer(row["bias"], np.float32), np.frombuffer(row["context"], np.float32).reshape(classes.contexts, width))))
    return Model(classes, parameters, level, width)


def _by_row(docs: DataFrame, shared) -> DataFrame:
    """Of each row what heavy words give, and its other words with their counts."""

    def run(batches):
        lexicon_, model = shared.value
        # Words that aren't heavy have the number -1 and add nothing here.
        base, rest = (np.append(x, 0.0) for x in (lexicon_.base(lexicon_.counts), lexicon_.in_rest(lexicon_.counts)))
        rest[: lexicon_.words] = 0
        known_end = int(lexicon_.docs > 0)
        end = float(lexicon_.base(lexicon_.docs))

        def row_sums(x, sizes):
            return np.where(sizes > 0, np.add.reduceat(np.append(x, 0.0), np.cumsum(sizes) - sizes), 0.0)

        for batch in batches:
            out = [[] for _ in range(6)]
            for some in blocks(texts(batch.column("text"))):
                words, sizes = flat(some)
                at = lexicon_.find(words)
                by_model = row_sums(model.log_probability(lexicon_.in_row(at, sizes)), sizes + 1) / math.log(10)
                edges = np.cumsum(sizes)
                light = np.flatnonzero(at < 0)
                other = [Counter([words[i] for i in own.tolist()]) for own in np.split(light, np.searchsorted(light, edges[:-1]))]
                known = sizes - np.fromiter(map(Counter.total, other), np.int64, len(other)) + known_end
                parts = ((sizes + 1).tolist(), known.tolist(), (end + row_sums(base[at], sizes)).tolist(), (by_model + row_sums(rest[at], sizes)).tolist(), map(list, other), (list(x.values()) for x in other))
                for column, values in zip(out, parts, strict=True):
                    column.extend(values)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], names=["id", "held_out", "n_tokens", "known", "base", "model", "words", "times"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, known long, base double, model double, words array<binary>, times array<long>")


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, classes: int = CLASSES, groups: int = GROUPS, rounds: int = ROUNDS, steps: int = STEPS, word_steps: int = WORD_STEPS, heavy: int = HEAVY
) -> DataFrame:
    """One row per document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    context = docs.sparkSession.sparkContext
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (fold(id_col) == 1).alias("held_out"))
    learned = narrow.where(~F.col("held_out")).select("text")
    counts = cut(word_counts(learned))
    is_heavy = heavy_words(counts, heavy)
    lexicon_ = lexicon(counts, learned.count(), words, is_heavy)
    seen = code_counts(learned, context.broadcast((lexicon_,)), neighbours).toArrow()
    features = np.zeros(lexicon_.size * 2 * (SEEDS + 1), np.float32)
    features[seen["code"].to_numpy()] = seen["n"].to_numpy()
    shared = context.broadcast((lexicon_, Classes(features.reshape(lexicon_.size, -1), lexicon_.unigrams, classes, groups, OWN)))
    model = trained(cut(code_counts(learned, shared, contexts)), shared, lexicon_.size, rounds, steps, word_steps)
    rows = cut(_by_row(narrow, context.broadcast((lexicon_, model))).withColumn("row", F.monotonically_increasing_id()))
    other = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    light = counts.where(~is_heavy)
    n = F.coalesce(F.col("n"), F.lit(0))
    base = F.log10((n + 0.5) / (lexicon_.tokens + 0.5 * (lexicon_.kinds + 1)))
    rest = F.log10((n + 0.5) / (lexicon_.rest_tokens + 0.5 * (lexicon_.rest_kinds + 1)))
    added = other.join(light, "word", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * base).alias("more_base"), F.sum(F.col("times") * rest).alias("more_rest")
    )
    zero = F.lit(0.0)
    return rows.drop("words", "times").join(added, "row", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("held_out", F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(lexicon_.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("more_rest", zero)).alias("score"),
    )
