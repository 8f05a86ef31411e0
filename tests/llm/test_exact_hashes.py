"""Lines and windows that differ never count as equal, whatever their hashes."""

import numpy as np
from claimlens.llm import bytescan, quality_rules
from claimlens.llm.bytescan import Scan


def _thue_morse(n):
    out = "ab"
    while len(out) < n:
        out += out.translate({97: 98, 98: 97})
    return out[:n]


def _stats(texts):
    scan = Scan([t.encode() for t in texts])
    got = quality_rules._rules(scan, scan.hashes(scan.word_start, scan.word_end))
    return list(zip(got["n_dup_lines"].tolist(), got["n_repeat_words"].tolist(), strict=True))


def test_thue_morse_lines():
    line = _thue_morse(4096)
    other = line.translate({97: 98, 98: 97})
    assert _stats([f"{line}\n{other}", f"{line}\n{line}", "x"]) == [(0, 0), (1, 0), (0, 0)]
    scan = Scan([line.encode(), other.encode()])
    assert len(set(scan.hashes(scan.word_start, scan.word_end).tolist())) == 2


def test_equal_hashes_of_different_bytes(monkeypatch):
    texts = ["a b c\nd e f\na b c", "one two three four one two three", "", "x\ny"]
    want = [quality_rules._plain_repeats(t.encode()) for t in texts]
    assert _stats(texts) == want == [(1, 6), (0, 6), (0, 0), (0, 0)]
    monkeypatch.setattr(Scan, "hashes", lambda self, start, end: np.zeros(len(start), np.uint64))
    monkeypatch.setattr(quality_rules, "mix", lambda h: h * np.uint64(0))
    assert _stats(texts) == want


def test_long_prefix_sums(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 50, 333, 50)] * 2
    want = Scan(texts).hashes(*(lambda s: (s.doc_start, s.doc_end))(Scan(texts)))
    assert want[:4].tolist() == want[4:].tolist()
    monkeypatch.setattr(bytescan, "SUM_BYTES", 64)
    scan = Scan(texts)
    assert scan.hashes(scan.doc_start, scan.doc_end).tolist() == want.tolist()
    assert scan.differ(scan.doc_start[:4], scan.doc_end[:4], scan.doc_start[4:], scan.doc_end[4:]).tolist() == [False] * 4
    assert scan.differ(scan.doc_start[[1]], scan.doc_end[[1]], scan.doc_start[[3]], scan.doc_end[[3]]).tolist() == [True]
