"""Learned scores, cuts and features against plain Python that goes token by token and byte by byte."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleanmill.llm import lm, media
from gleanmill.llm.common import prepared

# ---- language model ---------------------------------------------------------


def words_of(text):
    return [*(text or "").lower().split(), None]


def pairs_of(text):
    words = words_of(text)
    return list(zip(["<begin>", *words], words))


class Counts:
    def __init__(self, texts):
        self.words, self.pairs, self.contexts = Counter(), Counter(), Counter()
        for text in texts:
            self.words.update(words_of(text))
            self.pairs.update(pairs_of(text))
            self.contexts.update(["<begin>", *words_of(text)])
        self.n, self.v = sum(self.words.values()), len(self.words)

    def parts(self, context, word):
        """Bucket of the context; bigram, unigram and uniform estimate."""
        seen = self.contexts[context]
        return (seen.bit_length(), self.pairs[context, word] / max(seen, 1), self.words[word] / max(self.n, 1), 1 / (self.v + 1))


def weights_of(counts, fold, shown=lambda p: p):
    """Expectation-maximisation, a token at a time; ``shown`` is what is seen of an estimate."""
    tokens = defaultdict(list)
    for text in fold:
        for context, word in pairs_of(text):
            bucket, p2, p1, p0 = counts.parts(context, word)
            tokens[bucket].append((shown(p2), shown(p1), p0))
    weights = {}
    for bucket in range(66):
        w = (0.3, 0.6, 0.1)
        if bucket not in tokens:
            weights[bucket] = weights.get(bucket - 1, w)
            continue
        for _ in range(60):
            sums = [0.0, 0.0, 0.0]
            for parts in tokens[bucket]:
                whole = sum(a * b for a, b in zip(w, parts))
                for k in range(3):
                    sums[k] += w[k] * parts[k] / whole
            w = [s / len(tokens[bucket]) for s in sums]
        w = [max(x, 1e-6) for x in w]
        weights[bucket] = [x / sum(w) for x in w]
    return weights


def score_of(counts, weights, text):
    total = 0.0
    for context, word in pairs_of(text):
        bucket, *parts = counts.parts(context, word)
        total += math.log10(sum(a * b for a, b in zip(weights[bucket], parts)))
    return total


def test_lm_scores_token_by_token(spark):
    prepared(spark)
    rng = random.Random(3)
    common = [f"c{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(common) if rng.random() < 0.6 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(40)))) for i in range(160)]
    rows += [(900, None), (901, ""), (902, "Same SAME same " * 30), (905, " ".join(rng.choice(common) for _ in range(4000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs, F.expr("doc_id % 7 <> 2"), F.expr("doc_id % 7 = 3")).collect()}
    train, fold = [t for i, t in rows if i % 7 != 2], [t for i, t in rows if i % 7 == 3]
    fit, whole = Counts(t for i, t in rows if i % 7 not in (2, 3)), Counts(train)
    on_grid = lambda p: 10 ** (round(math.log10(p) * lm.GRID) / lm.GRID) if p else 0.0
    gridded, exact = weights_of(fit, fold, on_grid), weights_of(fit, fold)
    assert len(scores) == len(rows)
    for i, text in rows:
        assert scores[i] == pytest.approx(score_of(whole, gridded, text), rel=1e-9)
    # weights from the grid explain the fold as well as those from exact estimates; a single text's score moves by up to 1.2 % here
    explained = [sum(score_of(fit, w, text) for text in fold) for w in (gridded, exact)]
    assert explained[0] == pytest.approx(explained[1], rel=1e-4)


def test_lm_odd_rows(spark):
    prepared(spark)
    rows = [(1, "a b a b", "x"), (1, "a b a b", "y"), (None, "a b", "z"), (None, None, None), (2, "b " * 60000, "x"), (3, "", ""), (4, "A B c\x0bd", "x"), (9, "held out words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string").withColumn("kind", F.lit("k")).withColumn("tokens", F.lit(1))
    got = lm.lm_scores(docs, F.expr("doc_id <> 9"), F.expr("doc_id = 3")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((i is None, i or 0, len((t or "").encode().split()) + 1) for i, t, _ in rows)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    # nothing to learn from: all tokens are unknown, all scores finite
    none = lm.lm_scores(docs, F.lit(False), F.lit(False)).collect()
    assert len(none) == len(rows) and {(r["n_known"], r["train_tokens"]) for r in none} == {(0, 0)}
    assert all(math.isfinite(r["score"]) for r in none)


# ---- media ------------------------------------------------------------------


def plain_ends(data):
    """Rolling gear hash, a byte at a time."""
    h, start, ends = 0, 0, []
    gear = [int(g) for g in media.GEAR]
    for at, byte in enumerate(data, 1):
        h = ((h << 1) + gear[byte]) & 0xFFFFFFFF
        if (at - start >= media.LEAST and h >> (32 - media.CUT_BITS) == 0) or at - start == media.MOST or at == len(data):
            ends.append(at)
            start = at
    return ends


def test_cuts_byte_by_byte():
    rng = random.Random(8)
    for size, letters in ((192, 256), (384, 3), (8192, 1), (8193, 1), (60000, 256), (60000, 26), (60000, 2), (40000, 1)):
        data = bytes(rng.randrange(letters) + (97 if letters <= 26 else 0) for _ in range(size))
        ends = media.chunk_ends(data)
        assert ends == plain_ends(data)
        assert ends[-1] == size and all(b - a <= media.MOST for a, b in zip([0, *ends], ends))


def plain_feature(samples):
    n, bins = len(samples), Counter(b // 16 for b in samples)
    mean = sum(samples) * 100 // n
    variance = (n * sum(b * b for b in samples) - sum(samples) ** 2) * 100 // n**2
    return f"{mean};{variance};{','.join(str(bins[k] * 1000 // n) for k in range(16))}"


def test_media_columns_and_owners(spark):
    prepared(spark)
    rng = random.Random(9)
    base = " ".join(f"w{rng.randrange(90000)}" for _ in range(4000))
    rows = [(1, base), (2, base[:9000] + " new " + base[9000:]), (3, base), (4, None), (5, "ü\x00￿" * 900), (6, " " * 30000), (7, base[12000:] + base[:12000]), (None, "no id")]
    catalogue, store = media.store_media(spark.createDataFrame(rows, "doc_id long, text string"))
    payloads = {}
    for i, text in rows:
        data = (text or "").encode()
        payloads[i] = data + b" " * (-len(data) % 192 if data else 192)
    images = {i: b"P6\n64 %d\n255\n" % (len(p) // 192) + p for i, p in payloads.items()}
    got = {r["doc_id"]: r for r in catalogue.join(media.read_media(store), "media").collect()}
    for i, p in payloads.items():
        r = got[i]
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(images[i]), hashlib.sha256(images[i]).hexdigest(), plain_feature(p))
    # every image lists its chunks in order, and of each chunk one place owns it: the first by digest of the image
    chunks = {}
    for i, p in payloads.items():
        ends = plain_ends(p)
        chunks[hashlib.sha256(images[i]).digest()] = [hashlib.sha256(p[a:b]).digest()[:20] for a, b in zip([0, *ends], ends)]
    first = {}
    for image in sorted(chunks):
        for seq, digest in enumerate(chunks[image]):
            first.setdefault(digest, (image, seq))
    stored = {bytes(r["media"]): r["chunks"] for r in store.collect()}
    assert stored.keys() == chunks.keys()
    for image, listed in stored.items():
        assert [bytes(c["digest"]) for c in listed] == chunks[image]
        assert [c["owned"] for c in listed] == [first[d] == (image, seq) for seq, d in enumerate(chunks[image])]
