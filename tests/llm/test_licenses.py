"""License scans against a scan that tries every place, template and chain."""

import random
import re

from gleanmill.llm import licenses as L
from gleanmill.llm.common import prepared

BOOK = L.Book()


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


TEXTS = [plain_words(t) for _, t in (*L.PHRASES, *L.TEMPLATES)]


PARTS = {tuple(t[a:b]) for t in TEXTS for a in range(len(t)) for b in range(a + 1, len(t) + 1)}


def plain_matches(words):
    """(last word, size) of matches of LEAST words or more that no word lengthens on either side."""
    longest = []
    for i in range(len(words)):
        size = 0
        while size <= i and tuple(words[i - size : i + 1]) in PARTS:
            size += 1
        longest.append(size)
    return [
        (i, n) for i, n in enumerate(longest)
        if n >= L.LEAST and (i + 1 == len(words) or longest[i + 1] <= n)
    ]


def plain_scan(text):
    words = plain_words(text)
    places = [
        (i, label) for label, phrase in L.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    ]
    share = 0.0
    found, long_ones = set(), plain_matches(words)
    for label, template in zip([x for x, _ in L.TEMPLATES], TEXTS[len(L.PHRASES) :]):
        matches = [
            (i, e, n) for i, n in long_ones for e in range(n, len(template) + 1) if template[e - n : e] == words[i - n + 1 : i + 1]
        ]
        best = []
        for k, (i, e, n) in enumerate(matches):
            top = n
            for j in range(k):
                i2, e2, _ = matches[j]
                shared = max(0, i2 + 1 - (i - n + 1), e2 - (e - n))
                if i2 < i and e2 < e and shared < n and i2 + L.GAP >= i - n + 1:
                    top = max(top, best[j] + n - shared)
            best.append(top)
        own = max(best, default=0) / len(template)
        share = max(share, own)
        if own >= L.SHARE:
            found.add(label)
    base = {label for _, label in places}
    firsts = sorted(i for i, _ in places)
    return len(words), len(places), firsts[0] if firsts else None, firsts[-1] if firsts else None, base, base | found, 1.0 if places else share


def made(rng):
    out = []
    for _ in range(rng.randrange(1, 5)):
        out += [rng.choice(("word", "the", "license", "Ünï", "of", "software", "x_1")) for _ in range(rng.randrange(15))]
        words = rng.choice(TEXTS)
        a = rng.randrange(len(words))
        piece = words[a : a + rng.randrange(1, len(words) + 1)]
        if rng.random() < 0.5:
            piece = [w for w in piece if rng.random() > 0.05]
        out += [w.upper() if rng.random() < 0.2 else w for w in piece]
    return rng.choice((" ", "-", "\n", ". ")).join(out)


def test_scan_against_every_place():
    rng = random.Random(1)
    for _ in range(150):
        text = made(rng)
        s, want = BOOK.scan(text), plain_scan(text)
        assert (s.n_words, s.n_base, s.first, s.last, s.base) == want[:5], text
        assert abs(s.share - want[6]) < 1e-12, text
        labels = s.base | {BOOK.labels[t] for t, *_ in s.spans}
        # where spans of several templates overlap, the one that covers most stands for all
        assert labels <= want[5] and bool(labels) == bool(want[5]), text
        ends = [(first, last) for _, first, last, _ in s.spans]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_every_template_is_found_and_nothing_else():
    for (label, text), words in zip(L.TEMPLATES, TEXTS[len(L.PHRASES) :]):
        s = BOOK.scan("front matter " + text + " and more of it")
        assert label in {BOOK.labels[t] for t, *_ in s.spans}, label
        assert max(n for _, _, _, n in s.spans) == len(words) and s.share == 1.0
    notice = BOOK.scan("Licensed under CC BY-NC 4.0.")
    assert notice.base == {"cc-by"} and {BOOK.labels[t] for t, *_ in notice.spans} == {"cc-by-nc"}
    assert (notice.n_base, notice.first, notice.last) == (1, 2, 2)
    mit = dict(L.TEMPLATES[::-1])["mit"].replace("any person obtaining", "each and every person who has got")
    assert "mit" in {BOOK.labels[t] for t, *_ in BOOK.scan(mit).spans}
    for text in ("", None, "the license of the software", "a license to use this software is free", "MIT licensed"):
        s = BOOK.scan(text)
        assert not s.base and not s.spans and s.share < L.SHARE
    assert BOOK.scan("cc by cc by cc by").n_base == 3
    assert BOOK.scan("CC\x00BY and apache\nLicense, ccby").base == {"cc-by", "apache"}


def test_pieces_do_not_matter(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(made(rng) for _ in range(4)) for _ in range(10)] + ["x" * 500 + " mit license"]
    seen = lambda s: (s.n_words, s.n_base, s.first, s.last, s.base, s.share, s.spans)
    whole = [seen(BOOK.scan(t)) for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(L, "PIECE", size)
        assert [seen(BOOK.scan(t)) for t in texts] == whole


def test_automaton_knows_all_parts():
    rng = random.Random(3)
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(6)] + [[0, 1], [0, 1], [0]]
    machine = L.Automaton(sequences)
    parts = {}
    for n, s in enumerate(sequences):
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                parts.setdefault(tuple(s[a:b]), set()).add((n, b))
    for part, ends in parts.items():
        state = 0
        for word in part:
            state = machine.step[state][word]
        assert set(machine.ends[state]) == ends
    assert (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0) not in parts


def test_odd_documents(spark):
    prepared(spark)
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "cc by"), (2, None), (3, ""), (4, " \n"),
            (5, "mit license " * 200000), (6, "é" * 100000), (7, "cc\tBY é😀")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words long, labels string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["labels"], r["score"]) for r in L.license_scan(frame).collect()), key=repr)
    assert got == sorted([
        (1, 5, 1, "mit", 1.0), (1, 5, 1, "mit", 1.0), (None, 2, 1, "cc-by", 1.0), (2, 0, 0, "", 0.0), (3, 0, 0, "", 0.0), (4, 0, 0, "", 0.0),
        (5, 400000, 200000, "mit", 1.0), (6, 1, 0, "", 0.0), (7, 3, 1, "cc-by", 1.0),
    ], key=repr)
    assert L.license_scan(frame.where("false")).count() == 0
