import random

import numpy as np

from tessera.llm import bwt


def test_equals_sorted_suffixes():
    rnd = random.Random(2)
    for trial in range(40):
        alphabet = rnd.choice(["ab", "abcdef", "xyzé"])
        texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 14))).encode() for _ in range(rnd.randint(1, 12))]
        data = np.frombuffer(b"#".join(texts), np.uint8)
        size = np.array([len(t) for t in texts])
        start = np.cumsum(np.r_[0, size[:-1] + 1])
        got = bwt.build(data, start, size)
        want = sorted((t[len(t) - n:], i, n) for i, t in enumerate(texts) for n in range(len(t) + 1))
        key = [(texts[i][len(texts[i]) - n:]) for i, n in zip(got.text, got.size)]
        assert key == [w[0] for w in want]
        assert sorted(zip(got.text.tolist(), got.size.tolist())) == sorted((w[1], w[2]) for w in want)
        for k in range(1, len(key)):
            a, b, n = key[k - 1], key[k], 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert got.common[k] == n
        values = np.unique(data).tolist()
        for i, n, s in zip(got.text.tolist(), got.size.tolist(), got.symbol.tolist()):
            t = texts[i]
            assert s == (0 if n == len(t) else 1 + values.index(t[len(t) - n - 1]))


def test_no_texts():
    none = np.zeros(0, np.int64)
    assert len(bwt.build(np.zeros(0, np.uint8), none, none).text) == 0
