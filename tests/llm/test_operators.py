"""Every operator on odd rows, and against brute force."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from claimlens.llm import brown_lm, bpe_count, html_text, licenses, line_crf, mtree, nbest, packing, pieces, quality_rules, simhash
from claimlens.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = "word another thing " * 3000
#: nulls, empty and long texts, ties, repeated rows, and columns with clashing names
ODD = [
    (1, None, "x", 1),
    (2, "", "x", 2),
    (3, " \t\n\n ", None, None),
    (None, "a null key has this text", "x", 3),
    (5, LONG, "x", 4),
    (6, "The same text twice. With two lines.\nThe same text twice. With two lines.", "x", 5),
    (6, "The same text twice. With two lines.\nThe same text twice. With two lines.", "x", 5),
    (7, "é一☃🙂 <|endoftext|> ▁x  two  spaces\r\n", "x", 6),
]
SCHEMA = "doc_id long, text string, key string, _text long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 0, 0), (7, None, None), (None, 1, 0)], LABELS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def base_stats(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_quality_rules(odd, none, labels):
    ratio = quality_rules.fit(odd, labels)
    rows = quality_rules.rate(odd, ratio).collect()
    assert len(rows) == len(ODD)
    texts = collections.Counter((i, base_stats(t)) for i, t, _, _ in ODD)
    assert collections.Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rows) == texts
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.rate(none, quality_rules.fit(none, labels.limit(0))).count() == 0
    assert quality_rules.keep(odd, labels).columns == odd.columns
    assert not quality_rules.fit(odd, labels.limit(0)).any()


def test_quality_rules_ratio_is_the_two_multinomials(spark):
    docs = spark.createDataFrame([(1, "good plain words"), (2, "bad *** words"), (3, "bad *** ***")], "doc_id long, text string")
    ratio = quality_rules.fit(docs, spark.createDataFrame([(1, 1, 0)], LABELS))
    own = {r.doc_id: r.llr for r in quality_rules.rate(docs, ratio).collect()}
    assert own[1] > own[2] > own[3]


def test_line_crf(odd, none, labels):
    field = line_crf.fit(odd, labels)
    rows = line_crf.score(odd, field).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
    assert line_crf.score(none, line_crf.fit(none, labels)).count() == 0
    blank = line_crf.fit(odd, labels.limit(0))
    assert all(abs(r.score - 0.5) < 1e-9 for r in line_crf.score(odd, blank).collect())


def test_chain_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 4, 2, 6])
    logit, move = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    good, pairs = line_crf.chain_marginals(logit, lengths, move)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in lengths:
        own = logit[at : at + n]
        weight = {y: math.exp(sum(own[i] * v for i, v in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=int(n))}
        total = sum(weight.values())
        for i in range(n):
            assert abs(good[at + i] - sum(w for y, w in weight.items() if y[i]) / total) < 1e-9
        for y, w in weight.items():
            for a, b in zip(y, y[1:], strict=False):
                want_pairs[a, b] += w / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_line_crf_held_out(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = line_crf.score(docs, line_crf.fit(docs, marks)).filter("held_out").join(marks, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_packing(odd, none):
    from tokenizers import Tokenizer

    path = Q.tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(odd, path, width=64).collect()
    want = collections.Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, _, _ in ODD)
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    for r in rows:
        assert any(i == r.doc_id and len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for i, ids in want)
    windows = collections.defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    for k, parts in windows.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 64 or (end < 64 and end & (end - 1) == 0)
    assert packing.pack(none, path).count() == 0


def test_token_ids_are_the_library_s():
    path = Q.tokenizer_path("byte_bpe_50k.json")
    ids = packing.TextIds(path)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ET'sd.,  \n\t12é ²_\xa0") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t, got in zip(texts, ids.batch(texts), strict=True):
        assert np.frombuffer(got, np.uint16).tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_bpe_count(odd, none):
    import sentencepiece

    path = Q.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = bpe_count.token_counts(odd, path).collect()
    want = collections.Counter((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _, _ in ODD)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows)
    assert bpe_count.token_counts(none, path).count() == 0
    counter, rng = bpe_count.Counter(path), random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice("abthein ▁  .,é一\n0129<>s") for _ in range(rng.randint(0, 50)))
        assert counter.count(t) == len(library.encode(t)), t


def _all_segmentations(run, vocab):
    unknown, out = nbest.unknown_score(vocab), []
    for cuts in itertools.product((0, 1), repeat=len(run) - 1):
        parts, begin = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(run[begin:i])
                begin = i
        if all(p in vocab.score or len(p) == 1 for p in parts):
            out.append((-sum(vocab.score.get(p, unknown) for p in parts), tuple(map(len, parts[::-1])), parts))
    return sorted(out)


def test_nbest(odd, none):
    path = Q.tokenizer_path("piece_bpe_32k.model")
    vocab = pieces.vocabulary(path)
    for run in ("▁the", "tion", "aaaaaa", "▁▁a", "é一☃", "▁therein"):
        want = _all_segmentations(run, vocab)[:4]
        assert [(-s, p) for s, _, p in want] == nbest.run_nbest(run, vocab)
    encoder = nbest.Encoder(path)
    for t in ("the then", "a in", "x, y.", "ab  cd"):
        want = [-s for s, _, _ in _all_segmentations("▁" + t.replace(" ", "▁"), vocab)[:4]]
        scores, raw = encoder.encode(t)
        assert [s for s, _ in scores] == want
        assert nbest.decode(np.frombuffer(raw, np.uint32).tolist(), vocab) == t
    rows = nbest.nbest(odd, path).collect()
    assert len(rows) == len(ODD) and all(r.decodes for r in rows)
    assert all(r.scores == sorted(r.scores, reverse=True) for r in rows)
    assert nbest.nbest(none, path).count() == 0


def _fingerprint(text, shingle=3):
    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def _closure(values, distance):
    root = list(range(len(values)))
    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= distance:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert collections.Counter((r.doc_id, r.fingerprint) for r in rows) == collections.Counter((i, f"{_fingerprint(t):016x}") for i, t, _, _ in ODD)
    ids = [i for i, _, _, _ in ODD]
    root = _closure([_fingerprint(t) for _, t, _, _ in ODD], 2)
    want = collections.Counter((i, min((ids[k] for k in range(len(ids)) if root[k] == r and ids[k] is not None), default=None)) for i, r in zip(ids, root, strict=True))
    assert collections.Counter((r.doc_id, r.component_id) for r in rows) == want
    assert simhash.near_duplicates(none).count() == 0
    assert sorted(map(str, (r.doc_id for r in simhash.keep(odd).collect()))) == ["1", "5", "6", "7", "None"]


@pytest.mark.parametrize("bucket", [3, 10_000])
def test_simhash_links_lose_nothing(spark, bucket):
    rng = random.Random(2)
    values = set()
    for _ in range(30):
        v = rng.getrandbits(64)
        for _ in range(12):
            values.add(v)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                v ^= 1 << b
    values = sorted(values)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    for total in (len(values), 10**9):
        how = simhash.plan(np.array(values, np.uint64), total)
        assert sum(how.thresholds) == simhash.DISTANCE - len(how.thresholds) + 1
        found = {r.v & (2**64 - 1): r.m & (2**64 - 1) for r in simhash.components(simhash.find_links(frame, how, bucket=bucket)).collect()}
        want = _closure(values, 2)
        groups = collections.defaultdict(set)
        for v, r in zip(values, want, strict=True):
            groups[r].add(v)
        mine = collections.defaultdict(set)
        for v in values:
            mine[found.get(v, v)].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_simhash_large_bucket_equals_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 2**14, 700).astype(np.uint64) * np.uint64(2**20 + 1))
    want = simhash.linked(values)
    monkeypatch.setattr(simhash, "PAIRWISE", 10)
    assert (simhash.linked(values) == want).all()


def test_brown_lm(odd, none):
    rows = brown_lm.score(odd).collect()
    assert len(rows) == len(ODD)
    words = [[*WORD.findall(lower(t or "")), None] for _, t, _, _ in ODD]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _, _, _ in ODD]
    counts = collections.Counter(w for h, ws in zip(held, words, strict=True) if not h for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = collections.Counter((i, h, len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), 4)) for (i, _, _, _), h, ws in zip(ODD, held, words, strict=True))
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score <= 0 for r in rows)
    assert brown_lm.score(none).count() == 0


def test_brown_lm_beats_its_base_on_held_out_texts(spark):
    rows = brown_lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_exchange_finds_two_classes():
    n = 20
    bigrams = np.zeros((n + 1, n + 1))
    for i in range(n):
        for j in range(n):
            bigrams[i, j] = 10 if i % 2 != j % 2 else 0
    of = brown_lm.exchange(bigrams, classes=3, sweeps=10)
    assert not set(of[::2]) & set(of[1::2])


def test_mtree(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(900, 6)).astype(np.float32)
    base[300:700] = base[0]  # one common vector
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(5000, None), (5001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5002, [float("nan")] * 6), (5003, [float("inf")] * 6), (5100, []), (5200, [1.0, 2.0]), (5201, [2.0, 1.0]), (None, [1.0] * 6), (7, rows[7][1])]
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, block int, id string")
    got = mtree.top_k(frame, frame.filter("vec_id % 100 = 0")).collect()
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in whole:
        if q % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(found, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert mtree.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_licenses(odd, none, spark):
    text = licenses.LICENSES["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + text.upper().replace("SUBLICENSE", "SUB-LICENCE")),
        (2, "MIT License\n" + text.replace(" ", "  ")),
        (3, text + " And more."),
        (4, "Words.\nReleased under the MIT Licence\nThis work is licensed under the GNU General Public License, version 3."),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].license_id for k in (1, 2, 3, 4)] == ["MIT", "MIT", None, None]
    assert got[4].notices == "GPL-3.0,MIT" and got[1].notices == ""
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(none).count() == 0


PAGES = [
    ("", ""),
    (None, ""),
    ("plain text", "plain text"),
    ("<p>a<p>b &amp; c<br>d", "a\n\nb & c d"),
    ("<nav>menu</nav><article><h1>Head</h1><p>Body  text <b>bold</b>.</p><div class='ad'>Buy</div><script>x='</p>'</script></article><footer>f</footer>", "Head\n\nBody text bold."),
    ("<div id=sidebar>side text</div><div class=content><p>The article's long first paragraph of text.</p><p>Short.</p></div><section class=comments><p>A reader says this.</p></section>", "The article's long first paragraph of text.\n\nShort."),
    ("<article><p>Unclosed paragraph", "Unclosed paragraph"),
    ("<!-- c --><style>p{}</style><form><p>Name</p></form>", ""),
]


def test_html(spark):
    frame = spark.createDataFrame([(k, "u", h, 0, "x") for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text int, n_chars string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(frame).collect()}
    assert got == {k: (t, len(t)) for k, (_, t) in enumerate(PAGES)}
    assert html_text.extract(frame.limit(0)).count() == 0


def test_html_on_pages(spark):
    import html as H

    for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet"), keep=("page_id", "html")).collect():
        inside = re.search("<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = (" ".join(H.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside))
        assert r.text == "\n\n".join(b for b in blocks if b)
