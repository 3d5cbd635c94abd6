"""Context mixing: what is worked out once for equal bytes is what every byte on its own would give."""

import numpy as np

from barspark.llm import context_mixing


def some_texts():
    r = np.random.default_rng(8)
    words = [bytes(r.integers(97, 101, n).astype(np.uint8)) for n in (1, 2, 3, 4, 5, 6, 7, 9, 15, 30)] + ["été".encode(), "日本日本日本".encode(), b"x" * 3000]
    texts = [b"", b" ", b"a", b"abcd", b"abcde", b"abcdef", b"", b"\x00 \x00abcdefgh", b"Tab\tand\x0bNEWLINE\n"]
    return [context_mixing.plain(t) for t in texts + [b" ".join(words[i] for i in r.integers(0, len(words), n)) for n in (1, 2, 50, 400, 3000)] + [b""]]


def test_distinct_bytes_are_those_of_all_places():
    texts = some_texts()
    keys, word, sizes = context_mixing.grams(texts)
    want, n = np.unique(np.stack([keys, word]), axis=1, return_counts=True)
    *got, often = context_mixing.distinct_bytes(texts)
    order = np.lexsort(got[::-1])
    assert (np.stack(got)[:, order] == want).all() and (often[order] == n).all() and n.sum() == sizes.sum()


def test_score_is_the_sum_over_all_bytes():
    texts = some_texts()
    m = context_mixing.Mixer()
    r = np.random.default_rng(3)
    m.cells[:] = r.integers(-900, 900, m.cells.shape).astype(np.int16) << 3 | r.integers(0, 5, m.cells.shape).astype(np.int16)
    keys, word, sizes = context_mixing.grams(texts)
    want = context_mixing.CLASS_BITS + np.add.reduceat(m.bits(keys, word), np.cumsum(sizes) - sizes)
    np.testing.assert_allclose(m.score(texts), want, rtol=1e-5)
    np.testing.assert_allclose(m.score(texts), want, rtol=1e-5)  # from what the worker keeps
    m.memo = None
    np.testing.assert_allclose(np.concatenate([m.score([t]) for t in texts[::-1]])[::-1], want, rtol=1e-5)


def test_bits_of_half_a_byte_lie_together():
    keys, word, _ = context_mixing.grams(some_texts())
    slots = np.array([s for s, _, _ in context_mixing.places(keys, word)])
    for half in (slots[:4], slots[4:]):
        assert (half >> 4 == half[0] >> 4).all()
    assert len(np.unique(slots[:, 0] & 15)) == 16
