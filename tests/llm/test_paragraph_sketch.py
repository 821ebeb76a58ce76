import hashlib
import random

import numpy as np

from basepaths.llm import paragraph_sketch as P

MASK = 2**64 - 1


def mix(h):
    h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 29)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 32)


def paragraphs(raw):
    """The pieces of a text as a set of (bytes, how often before)."""
    out, start = [], 0
    for i, b in enumerate(raw):
        cut = b == 10
        if b == 32:
            seen = 0
            for k in range(1, 5):
                seen = (seen * 257 + (raw[i - k] if i >= k else 0)) & MASK
            cut = mix(seen) % P.PIECE_WORDS == 0
        if cut or i + 1 - start == P.LONGEST:
            out.append(raw[start : i + 1])
            start = i + 1
    out.append(raw[start:])
    out = [p.rstrip(b"\n") for p in out]
    return {(p, out[:n].count(p)) for n, p in enumerate(out) if p}


def alike(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    rng = random.Random(4)
    words = ["wört%d" % i for i in range(200)] + ["the", "of", "\n", "\n\n", "𝄞"]
    out = ["", None, "one", "one\n", "\n\n", "a b\na b\na b\nc", " ", "x" * 5000, "é" * 7]
    for n in (1, 2, 5, 40, 40, 300, 300, 3000):
        out.append(" ".join(rng.choice(words) for _ in range(n)))
    out += [out[-1], out[-1].replace("the", "teh"), out[-2][:500], "same line\n" * 400]
    return out


def test_pieces_and_likeness_against_sets():
    raw = [(t or "").encode() for t in texts()]
    got = P.Paragraphs(raw)
    assert got.sizes.tolist() == [len(paragraphs(t)) for t in raw]
    prints = P.sketched(got, P.CELLS, 0)
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(raw)) for j in range(len(raw))]))
    near = P.likeness(got, got, (a, b), (prints, prints))
    assert near.tolist() == [alike(raw[i], raw[j]) for i, j in zip(a, b)]
    assert len(set(prints.texts())) == len({frozenset(paragraphs(t)) for t in raw})


def test_larger_sketches_are_tried_until_the_difference_peels():
    big, small = " ".join(f"w{i}" for i in range(40_000)).encode(), b"w1 w2"
    old, new = P.Paragraphs([big, big]), P.Paragraphs([small, big + b"\nmore"])
    every = np.arange(2)
    pair, value, sign, tries = P.differences(old, new, (every, every), (P.sketched(old, P.CELLS, 0), P.sketched(new, P.CELLS, 0)))
    for row in every:
        left, right = set(old.values[old.row == row].tolist()), set(new.values[new.row == row].tolist())
        assert set(value[(pair == row) & (sign == 1)].tolist()) == left - right
        assert set(value[(pair == row) & (sign == -1)].tolist()) == right - left
    assert tries.tolist() == [tries[0], 1]


def test_fingerprints_can_be_read_back_and_peeled():
    old, new = P.Paragraphs([b"a\nb\nc\nd"]), P.Paragraphs([b"a\nb\nx\nd"])
    one, two = (P.Sketches.read(P.sketched(p, P.CELLS, 0).texts()) for p in (old, new))
    done, _, values, signs = one.less(two, np.array([0]), np.array([0])).peel()
    assert done.all() and sorted(signs.tolist()) == [-1, 1]
    assert set(values.tolist()) == set(old.values.tolist()) ^ set(new.values.tolist())


def test_long_texts_are_cut_as_short_ones_would_be(monkeypatch):
    rng = random.Random(5)
    text = " ".join("w%d" % rng.randrange(900) for _ in range(4000)) + "y" * 3000 + " z"
    monkeypatch.setattr(P, "LONGEST", 1000)
    raw = text.encode()
    assert P.Paragraphs([raw, b"a"]).sizes.tolist() == [len(paragraphs(raw)), 1]
    assert b"".join(P._split(raw)) == raw


def ring(rows):
    """Brute force over (doc_id, text)."""
    known = sorted(((i, t) for i, t in rows if i is not None), key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode()))
    pairs = [(r, known[(n + 1) % len(known)][1] or "") for n, r in enumerate(known)] + [(r, None) for r in rows if r[0] is None]
    out = []
    for (doc, text), after in pairs:
        text = text or ""
        gone = len(text) // 4
        edited = text[: len(text) - gone] + (after or "")[:gone]
        raw = text.encode()
        out.append((
            doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), alike(raw, edited.encode()), None if after is None else alike(raw, after.encode()),
            len(paragraphs(raw)),
        ))
    return sorted(out, key=repr)


def check(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, fingerprint string, _range double").repartition(3)
    got = P.edited_documents(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.n_paragraphs) for r in got), key=repr) == ring(rows)
    by_text = {}
    for row in got:
        by_text.setdefault((row.n_chars, row.fingerprint), set()).add(row.doc_id)
    return got


def test_ring_of_edited_documents(spark):
    rows = [(7 * i % 23 * 10 + i, t) for i, t in enumerate(texts())]
    got = check(spark, rows)
    text_of = dict(rows)
    prints = {}
    for r in got:
        prints.setdefault(text_of[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_ring_with_null_and_shared_ids(spark):
    check(spark, [(i % 3, t) for i, t in enumerate(texts())] + [(None, "some text here"), (None, None)])


def test_ring_of_one_none_and_a_text_of_megabytes(spark):
    check(spark, [(5, "abcdefgh")])
    check(spark, [])
    check(spark, [(None, "abcdefgh")])
    rng = random.Random(6)
    long = " ".join("w%d" % rng.randrange(50_000) for _ in range(300_000))
    df = spark.createDataFrame([(1, long), (2, "é" * 900_000), (3, long[:-9])], "doc_id long, text string")
    got = {r.doc_id: r for r in P.edited_documents(df).collect()}
    assert got[1].n_chars == len(long) and 0.5 < got[1].near_edited < 0.8 and got[1].near_next == 0 and got[3].near_next > 0.99


def test_versions(spark):
    rows = [(1, "a\nb\nc", "a\nc\nd"), (2, None, None), (3, None, "x"), (4, "same", "same")]
    got = {r.key: r for r in P.version_differences(spark.createDataFrame(rows, "key long, old string, new string"), "key", "old", "new").collect()}
    assert (len(got[1].only_old), len(got[1].only_new), got[1].likeness) == (1, 1, 0.5)
    assert (got[2].likeness, got[3].likeness, got[4].likeness) == (1.0, 0.0, 1.0)
    assert got[4].fingerprint == got[4].new_fingerprint and got[4].only_old == []
