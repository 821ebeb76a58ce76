import random
import re

from basepaths.llm import licenses as L


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(rows, templates):
    """Best containment over the same windows, all of them."""
    out = {}
    for doc, text in rows:
        g = grams(text)
        for name, t in templates.items():
            m = len(grams(t))
            step = -(-m // 4) + 1
            for at in range(0, max(1, len(g)), step):
                share = len(set(grams(t)) & set(g[at : at + m + step - 1])) / len(set(grams(t)))
                if share >= L.CONTAINMENT:
                    out[doc, name] = max(out.get((doc, name), (0.0, 0)), (share, -at))
    return sorted((d, n, round(s, 9), -a) for (d, n), (s, a) in out.items())


def test_against_all_windows(spark):
    rng = random.Random(7)
    vocab = ["wört%d" % i for i in range(80)] + ["license", "the", "under"]
    rows = []
    for i in range(80):
        parts = [rng.choice(vocab) for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(3)):
            notice = re.split(r"\s+", rng.choice(list(L.TEMPLATES.values())))
            if rng.random() < 0.4:
                notice[rng.randrange(len(notice))] = "other"
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = [x.upper() if rng.random() < 0.3 else x for x in notice]
        rows.append((i, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "Released under the MIT"), (103, "Released\n\nunder THE (mit) license")]
    docs = spark.createDataFrame([(d, t, "x", [1]) for d, t in rows], "doc_id long, text string, template string, sh array<int>")
    got = sorted((r.doc_id, r.template, round(r.containment, 9), r.first_word) for r in L.scan(docs).collect())
    assert got == brute(rows, L.TEMPLATES) and len(got) > 40
    assert L.scan(docs.limit(0)).collect() == []


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")] * 2 + [(None, "x " * 3000 + "released under the mit license")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.template, r.first_word) for r in L.scan(docs).collect()) == [("1", "mit-notice", 0), ("None", "mit-notice", 3000)]
