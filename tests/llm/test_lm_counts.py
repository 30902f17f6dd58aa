"""The language model learns from every count, and texts in a row are as each alone."""

import numpy as np

from strandline.llm import lm


def test_op8_trains_on_every_count():
    """Training asks for no draw: a count that falls between all draws still moves its word, and repeated counts change nothing by chance."""
    n = 40
    unigrams = np.append(np.full(n, 1e6), (0.0, 1e6, 0.0))
    classes = lm.Classes(np.ones((n + 3, 2 * (lm.SEEDS + 1)), np.float32), unigrams, 8, 6, 2, near=4)
    size, word = len(classes.of), np.flatnonzero((classes.size[classes.of] > 1) & (np.arange(n + 3) < n))
    code, counts = np.sort(3 * size + word), np.full(len(word), 10**9)
    rare = np.array([2 * size + word[-1]])

    def vectors(codes, times):
        order = np.argsort(codes)
        return lm.word_nce(classes, codes[order], times[order], 4, 4, 0)[3]

    plain, more = vectors(code, counts), vectors(np.append(code, rare), np.append(counts, 1))
    assert not np.array_equal(plain[2], more[2])
    cells = lm.Cells(*np.divmod(code, size), counts, 4, 2)
    wide = lm.Cells(np.repeat(np.arange(10), 3), np.arange(30), np.arange(1, 31), 7, 3)
    seen = np.zeros(30)
    for own in wide.steps(np.random.default_rng(1)):
        at, target, times = wide.rows(own)
        assert np.array_equal(wide.contexts[own][at], target // 3) and np.array_equal(times, target + 1)
        seen[target] += 1
    assert (seen == 3).all() and cells.parts == 1

    first = classes.contexts * classes.n
    table = np.array([4 * first + 3 * classes.n + c for c in range(4)] + [5 * first + 2 * classes.n + 1])
    start = lm.class_parameters(classes, 4)
    done = lm.class_nce(start, classes, table, np.array([10**9] * 4 + [1]), 4, 0)
    assert not np.array_equal(done[0][5], start[0][5]) and not np.array_equal(done[1][2], start[1][2])


def test_op8_texts_in_a_row():
    """Texts that are joined end to end score and count as each alone."""
    words = [(f"w{i}".encode(), 100 - i) for i in range(20)]
    lexicon = lm.Lexicon(words, 2000, 30, 9, 10)
    classes = lm.Classes(np.random.default_rng(1).random((lexicon.size, 2 * (lm.SEEDS + 1))).astype(np.float32), lexicon.unigrams, 8, 6, 2, near=4)
    sizes = np.array([0, 3, 1, 0, 7, 0])
    at = np.random.default_rng(2).integers(-1, 20, sizes.sum())
    alone = [lexicon.tokens_of(x) for x in np.split(at, np.cumsum(sizes)[:-1])]
    row = lexicon.in_row(at, sizes)
    assert np.array_equal(row, np.concatenate(alone))
    for codes in (lm.neighbours, lm.contexts):
        for whole, *parts in zip(codes((lexicon, classes), row), *[codes((lexicon, classes), x) for x in alone], strict=True):
            assert np.array_equal(whole, np.concatenate(parts))
    model = lm.Model(classes, lm.class_parameters(classes, 4), [], 4)
    assert np.array_equal(model.log_probability(row), np.concatenate([model.log_probability(x) for x in alone]))
