import hashlib
import random
import re

import numpy as np
import pytest
from graphloom.llm import pii, queries

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(sum(divmod(v, 10)) for v in doubled) % 10 == 0


def plain(text):
    """The patterns as the contract has them, by plain searches."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and plain_luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def parsed(spans):
    return {(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)}


def test_base_spans_against_plain_patterns():
    rng = random.Random(6)
    hard = ["a@b.c@d.e.f", "@a.b", "x@y", "a.b@c..d", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.0003.0255", "1.2.3", "4111 1111 1111 1111 2", "+1 (234) 567-8901", "+1", "+12 +3456789012", "٣.٣.٣.٣", "4111-1111-1111-1111", "9.4111111111111111"]
    made = ["".join(rng.choice("ab@@..+%-12344 1().é\n") for _ in range(rng.randrange(60))) for _ in range(4000)]
    for text in hard + made + ["".join(rng.choice("0123. +-(") for _ in range(80)) for _ in range(1500)]:
        assert pii.base_spans(text) == plain(text), text
    assert pii.base_spans("a" * 300_000 + "@" + "1" * 300_000) == [] and len(pii.base_spans("a@b.c " * 50_000)) == 50_000


@pytest.fixture(scope="module")
def net(spark):
    return pii.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_query_base_spans_and_what_is_added(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_pii(spark, SF).collect()
    assert len(got) == len(rows)
    added = clean = 0
    for r in got:
        want = plain(rows[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in want) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        every = parsed(r.spans)
        assert every >= set(want) and listed(sorted(every)) == r.spans and len(every) == len(want) + r.n_added
        ends = sorted((a, b) for a, k, b in every - set(want))
        assert all(b <= c for (_, b), (c, _) in zip(ends[:-1], ends[1:], strict=True))
        added += r.n_added
        clean += not want
    assert clean > 500 and added <= 0.01 * len(rows)


def test_written_forms_are_found_anywhere_in_long_texts(spark, net):
    """Forms that the patterns miss, filled anew and put at random places of held-out texts of several windows; the base ones are found by the network alone as well."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text and len(r.text) > 1500]
    rng = random.Random(8)
    words = ["alice", "martin", "orange", "delta"]
    rate = {}
    for k, forms in pii.WRITTEN.items():
        found = tried = 0
        for form in forms:
            for _ in range(20):
                piece, text = pii._fill(form, rng, words), rng.choice(texts)[:1500]
                at = text.rfind(" ", 0, rng.randrange(100, 1400)) + 1
                text = text[:at] + piece + " " + text[at:]
                base = pii.base_spans(text)
                spans = [*base, *pii.reconcile(text, pii.found_spans(net, [text])[0], base)]
                found += any(kind == k and a < at + len(piece) and at < b and (b - a) * 2 > len(piece) for a, kind, b in spans)
                tried += 1
        rate[k] = found / tried
    assert min(rate.values()) > 0.75 and sum(rate.values()) / 4 > 0.88, rate


def test_slopes_against_differences():
    net, rng = pii.start(2), np.random.default_rng(1)
    for k in net.names():
        setattr(net, k, getattr(net, k).astype(np.float64))
    net.move[:], net.begin[:] = rng.normal(size=(pii.TAGS, pii.TAGS)), rng.normal(size=pii.TAGS)
    codes, tags = rng.integers(0, 90, (9, 4)).astype(np.uint8), rng.integers(0, pii.TAGS, (9, 4)).astype(np.uint8)
    codes[6:, 1] = pii.PAD
    _, slopes = pii.loss_and_slopes(net, codes, tags)
    for k in net.names():
        flat = getattr(net, k).reshape(-1)
        for i in [int(codes[0, 0]) * pii.EMBED, int(codes[4, 2]) * pii.EMBED + 3] if k == "embed" else rng.choice(flat.size, 5, replace=False):
            kept, losses = flat[i], []
            for step in (0.01, -0.01):
                flat[i] = kept + step
                losses.append(pii.loss_and_slopes(net, codes, tags)[0])
            flat[i] = kept
            assert abs((losses[0] - losses[1]) / 0.02 - slopes[k].reshape(-1)[i]) < 2e-3, (k, i)


def test_decoding_against_every_path():
    """Viterbi by trying all tag sequences, on emissions of an untrained network with strong transitions; padding changes nothing."""
    from itertools import product

    rng = np.random.default_rng(3)
    net = pii.start(4)
    net.move[:], net.begin[:] = rng.normal(size=(pii.TAGS, pii.TAGS)) * 2, rng.normal(size=pii.TAGS)
    net.out *= 6
    codes = rng.integers(0, 90, (5, 12)).astype(np.uint8)
    sizes = np.array([5] * 6 + [3] * 6)
    codes[3:, 6:] = pii.PAD
    scores = pii.emissions(net, codes)
    for w in range(6, 12):
        assert np.allclose(scores[:3, :, w], pii.emissions(net, codes[:3, w : w + 1])[:, :, 0], atol=1e-4)
    got = {}
    for w, a, b, k, score in pii.decode(net, scores, sizes):
        got.setdefault(w, []).append((a, b, k))
    for w in range(12):
        value = lambda p: net.begin[p[0]] + sum(scores[t, k, w] for t, k in enumerate(p)) + sum(net.move[a, b] for a, b in zip(p[:-1], p[1:], strict=True))  # noqa: B023, E731
        best = max(product(range(pii.TAGS), repeat=int(sizes[w])), key=value)
        if value(best) > value([0] * len(best)) + pii.MARGIN:
            edges = [0, *(t for t in range(1, len(best)) if best[t] != best[t - 1]), len(best)]
            assert got[w] == [(a, b, best[a] - 1) for a, b in zip(edges[:-1], edges[1:], strict=True) if best[a]]


def test_windows_cover_and_pieces_unite():
    for n in (0, 1, pii.STRIDE, pii.WINDOW, pii.WINDOW + 1, 5000):
        held = np.zeros(n, int)
        for a, b in pii.windows(n):
            held[a:b] += 1
        assert (held > 0).all() and (held <= 2).all()
    text = "call 030 / 1234567 or write, 12.13.14.15 "
    found = [(5, 12, 3, 3.0), (10, 18, 3, 9.0), (8, 16, 1, 4.0), (29, 40, 1, 8.0), (22, 27, 0, 9.0), (0, 4, 3, 0.1)]
    assert pii.reconcile(text, found, pii.base_spans(text)) == [(5, 3, 18)]


def test_edges(spark, net):
    rows = [(1, None), (2, ""), (3, "a@b.co 1.2.3.4"), (3, "a@b.co 1.2.3.4"), (None, "+1 (234) 567-8901"), (4, "text " * 60_000 + "a@b.co"), (5, "\U0001f600 a@b.co 中")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, spans string, n_ip int")
    got = [(r.doc_id, r.n_email, r.n_ip, r.n_phone, r.spans) for r in pii.find(df, net).collect()]
    want = [(i, *(sum(k == kind for _, k, _ in plain(t)) for kind in (0, 1, 3)), listed(plain(t))) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert pii.report(df.limit(0)).count() == 0
