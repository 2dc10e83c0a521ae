"""The operators against brute force, round trips and odd inputs."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from gleanmill.llm import chat, lines, lm, media, mixing, neardup, packing, quality, toxicity, warc
from gleanmill.llm.common import prepared
from gleanmill.llm.queries import public_vocabulary

ODD = [
    (1, "One two three four five six seven."), (2, None), (3, ""), (4, " \n\t "), (None, "Text without an id is here."),
    (5, "One two three four five six seven."), (5, "One two three four five six seven."), (6, "word " * 30000), (7, "é😀 \x00 ünï"),
]


@pytest.fixture(scope="module")
def odd(spark):
    prepared(spark)
    rows = [(i, t, "en", "s", 3, "x", "y") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, row string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def varied(seed, n, words=60, change=4):
    """Texts of which many are changed copies of earlier ones."""
    rng = random.Random(seed)
    made = []
    for i in range(n):
        if made and rng.random() < 0.6:
            text = list(rng.choice(made))
            for _ in range(rng.randrange(change)):
                text[rng.randrange(len(text))] = f"new{rng.randrange(1000)}"
        else:
            text = [f"w{rng.randrange(3000)}" for _ in range(words)]
        made.append(text)
    return [(i, " ".join(t)) for i, t in enumerate(made)]


def smallest_reachable(ids, links):
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            if group[a] != low or group[b] != low:
                group[a] = group[b] = low
                changed = True
    return group


def test_chat_round_trip(spark):
    prepared(spark)
    texts = ["", None, "###", "#####", "### user: x", "</turn>", "<\\/turn>", "\\", "\\\\#", "a\n\nb", "é😀", "# ## ###"]
    roles = ["user", "assistant", "assistant", "a: b", None]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "no id"), (1, None, "user", "first"), (2, 0, "user", "x"), (2, 0, "user", "x")]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, turns long")
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(frame)).collect()}
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [t[2:] for t in turns]
        assert got[conv]["loss_text"] == "".join(t[3] for t in turns if t[2] == "assistant")
    assert chat.read_chats(chat.format_chats(frame.where("false"))).count() == 0


def test_automaton_is_levenshtein():
    terms = ["idiot", "moron", "trash", "losers"]
    machine = toxicity.Automaton([(t, False, True) for t in terms])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(2)
    words = [w[:k] + rng.choice("abcdeilorst") * rng.randrange(2) + w[k + rng.randrange(2):] for w in terms for k in range(len(w) + 1) for _ in range(8)]
    for word in words + ["", "x", "idi", "idiooot", "morontrash"]:
        nearest = min((distance(word, t), k) for k, t in enumerate(terms))
        got = machine.match(word)
        assert got == nearest if nearest[0] <= 1 else got is None, word


def test_toxicity_learns_terms_stems_and_context(spark, odd, empty):
    rng = random.Random(3)
    plain = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(40))
    rows = [(plain(), 0) for _ in range(200)]
    rows += [(plain() + f" vek{rng.choice('abcdefgh')}o{rng.choice('xyz')} idiot " + plain(), 1) for _ in range(100)]
    model = toxicity.learn(rows)
    assert model.score("you are an idiot") > 0.5 > model.score(plain())
    assert model.score(f"some idoit idio1 {plain()}") > model.score(plain())
    assert model.score("you idiot") > model.score('he wrote "idiot"')
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.score(empty, model).count() == 0


def test_warc_payload_with_records_inside(spark, tmp_path):
    prepared(spark)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u", fake * 3), (2, None, None), (3, "a b\r\nc", ""), (4, "u", "same"), (5, "u", "same"), (6, "u", "WARC/1.1\r\n" * 50), (7, "ü", "é" * 5000), (None, "u", "same")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest long")
    warc.write_archives(pages.repartition(2), str(tmp_path / "a"))
    for block in (64, 1000, 1 << 20):
        records = warc.read_archives(spark, str(tmp_path / "a"), block_bytes=block)
        got = sorted(tuple(r) for r in warc.resolved(records).where("page_id is not null").collect())
        top = {"same": 5, "": 3}
        want = sorted(
            (i, len((h or "").encode()), __import__("base64").b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
             "response" if top.get(h or "", i) == i else "revisit", None if top.get(h or "", i) == i else top[h or ""], True)
            for i, _, h in rows if i is not None
        )
        assert got == want
    warc.write_archives(pages.where("false"), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0


def test_targets_are_the_iterated_reshare(spark):
    sizes = [("sa", 100), ("sb", 5000), ("sc", 10), ("sd", 0), ("t", 700)]
    frame = spark.createDataFrame(sizes, "skey string, size long")
    weights = dict(zip([s for s, _ in sizes], itertools.cycle((5.0, 2.0, 1.0))))
    left, targets, free = 1.5 * sum(n for _, n in sizes), {}, dict(sizes)
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        full = [s for s in free if share[s] >= 2 * free[s]]
        for s in full or list(free):
            targets[s] = 2.0 * free[s] if full else share[s]
            left -= targets[s]
            del free[s]
    got = {r["skey"]: r["target"] for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(targets)


def test_mix_nears_targets_and_repeats(spark, odd, empty):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(200), None if i % 3 == 0 else f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.mixed_totals(docs).collect()
    assert sorted(first) == sorted(mixing.mixed_totals(docs.repartition(7)).collect())
    source = {i: s for i, _, s in rows}
    for s in (None, "s1", "s2"):
        own = [r for r in first if source[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 5 * 64
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    assert mixing.mixed_totals(odd).count() == len(ODD)
    assert mixing.mixed_totals(empty).count() == mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_quality_figures(spark, odd, empty):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(60))) + rng.choice([".", "", "\nmenu | a | b | c | d", "\nx.\nx."]) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judged(docs).collect():
        words = texts[r["doc"]["doc_id"]].split()
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
        assert (r["n_words"], r["n_repeat_words"], r["word_chars"]) == (len(words), len(twice), sum(map(len, words)))
    got = {r["doc"]["doc_id"]: r for r in quality.judged(odd).collect()}
    assert len(got) == 8 - 0 and not got[2]["kept"] and got[6]["n_repeat_words"] == 30000
    assert quality.judged(empty).count() == 0


def test_lm_base_counts_and_order(spark, empty):
    prepared(spark)
    rows = varied(6, 120, 30)
    docs = spark.createDataFrame(rows + [(500, None), (501, "Same CASE same case")], "doc_id long, text string")
    train = "doc_id % 7 <> 2"
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in lm.lm_scores(docs, F.expr(train), F.expr("doc_id % 7 = 3")).collect()}
    counts = {}
    tokens = lambda t: [*(t or "").lower().split(), None]
    for i, t in [*rows, (500, None), (501, "Same CASE same case")]:
        if i % 7 != 2:
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    import math

    for i, t in [*rows, (500, None), (501, "Same CASE same case")]:
        r = got[i]
        assert (r["n_tokens"], r["train_tokens"]) == (len(tokens(t)), n)
        assert r["n_known"] == sum(w in counts for w in tokens(t))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens(t)))
    out = [r for i, r in got.items() if i % 7 == 2]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert lm.lm_scores(empty, F.expr(train), F.expr("doc_id % 7 = 3")).count() == 0


def test_fullest_is_optimal():
    rng = random.Random(7)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(1, 90)
        taken = packing.fullest(counts, room)
        sums = {sum(x * n for x, n in zip(counts, ns)) for ns in itertools.product(*(range(n + 1) for n in counts.values()))}
        assert sum(x * n for x, n in taken.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[x] for x, n in taken.items())


def test_packing_loses_nothing(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1500)))) for i in range(60)] + [(99, "<|endoftext|> x"), (98, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    pieces = packing.pack(docs, *public_vocabulary()).collect()
    import numpy as np

    for i, text in rows:
        mine = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in mine]).tolist()
        assert ids == own.encode(text or "", add_special_tokens=False).ids + [0]
        assert [p["start"] for p in mine] == [0, *itertools.accumulate(p["length"] for p in mine)][:-1]
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    for own_pieces in sequences.values():
        own_pieces.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own_pieces] == [0, *itertools.accumulate(p["length"] for p in own_pieces)][:-1]
        total = sum(p["length"] for p in own_pieces)
        assert total <= 1024 and total & (total - 1) == 0
    assert {p["doc_id"] for p in packing.pack(odd, *public_vocabulary()).collect()} == {i for i, _ in ODD}
    assert packing.pack(empty, *public_vocabulary()).count() == 0


def test_packing_ids_are_the_default_json_ids(spark, tmp_path):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from gleanmill.llm.queries import op7_pack_sequences

    prepared(spark)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|> x", "a <|endoftext|><|endoftext|>\n b", "a<|endoftext|>", "<|endoftext|", "x <|endoftext |>", "plain é😀", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: own.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert want[0] == [50256, 2124, 0]
    packed = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "").collect()
    pieces = op7_pack_sequences(spark, str(tmp_path)).collect()
    for i, ids in want.items():
        mine = sorted((p for p in packed if p["doc_id"] == i), key=lambda p: p["start"])
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in mine]).tolist() == ids
        of_query = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert [p["ids_crc32"] for p in of_query] == [
            zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for p in of_query
        ]
        assert {p["doc_tokens"] for p in of_query} == {len(ids)}


def test_packing_of_long_runs(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from gleanmill.llm.queries import public_specials

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model = packing.encoder(*public_vocabulary(), public_specials())
    runs = [" " * 2000, "\n" * 1500 + " ", "\u3000 \t" * 700, " " * 999, " " * 1000, " " * 1001 + "\u2003"]
    for run in runs:
        for text in (run, "a" + run, run + "b", f"a{run}b{run}.", f"x{run}<|endoftext|>{run}y", f"{run}\x1c{run}é", run + "'s"):
            assert packing.encoded(model, text).tolist() == own.encode(text, add_special_tokens=False).ids, (run[:3], text[-3:])
    rng = random.Random(21)
    blanks, word = "a" + " " * 2_000_000 + "b", "".join(rng.choice("abcdefgh") for _ in range(5_000_000))
    prepared(spark)
    packed = packing.pack(spark.createDataFrame([(1, blanks), (2, word)], "doc_id long, text string"), *public_vocabulary()).collect()
    for i, text in ((1, blanks), (2, word)):
        mine = sorted((p for p in packed if p["doc_id"] == i), key=lambda p: p["start"])
        ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in mine]).tolist()
        assert ids[-1] == 0 and b"".join(map(model.decode_single_token_bytes, ids[:-1])) == text.encode()


def test_header_scan_is_linear(tmp_path):
    import time

    from pyarrow import fs

    for name, tail in (("blank", b"a b" * 6_000_000), ("letters", b"a" * 16_000_000), ("value", b"x:" + b"a" * 16_000_000), ("none", b"\r" * 16_000_000)):
        path = tmp_path / name
        path.write_bytes(warc.MAGIC + tail)
        with fs.LocalFileSystem().open_input_file(str(path)) as file:
            start = time.time()
            assert warc.header_at(file, 0, path.stat().st_size) is None
            assert time.time() - start < 2, name
    good = tmp_path / "good"
    good.write_bytes(warc.MAGIC + b"A: " + b"v" * 10_000 + b"\r\nContent-Length: 3\r\n\r\nabc")
    with fs.LocalFileSystem().open_input_file(str(good)) as file:
        fields, end = warc.header_at(file, 0, good.stat().st_size)
        assert (fields["content-length"], len(fields["a"]), end) == ("3", 10_000, good.stat().st_size - 3)


def test_mix_of_small_sources(spark):
    rng = random.Random(22)
    sizes = [30000, 5, 10, 12, 20, 30, 41, 55, 60, 63, 1, 70, 640]
    rows = []
    for k, size in enumerate(sizes):
        left = size
        while left:
            n = min(left, rng.randrange(1, 400))
            rows.append((len(rows), "w " * n, f"s{k:02}"))
            left -= n
    got = mixing.mixed_totals(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    for k, size in enumerate(sizes):
        own = [r for r in got if rows[r["doc_id"]][2] == f"s{k:02}"]
        taken, target = sum(r["taken"] for r in own), own[0]["target"]
        assert own[0]["source_size"] == size and abs(taken - target) <= max(1, min(64, size // 64)), (size, taken, target)
        assert all(r["taken"] <= 2 * r["size"] for r in own)


def test_short_terms_may_be_misspelled():
    rng = random.Random(23)
    plain = lambda: " ".join(f"w{rng.randrange(900):03}" for _ in range(40))
    model = toxicity.learn([(plain(), 0) for _ in range(300)] + [(f"{plain()} scum {plain()}", 1) for _ in range(60)])
    assert model.score("you scvm " + plain()) > 0.5 > model.score(plain())
    # a near word of clean texts is no misspelling
    clean = [(plain() + " scam", 0) for _ in range(300)]
    model = toxicity.learn(clean + [(f"{plain()} scum {plain()}", 1) for _ in range(60)])
    assert model.score("scam " + plain()) < 0.5 < model.score("scum " + plain())


def test_lines_against_all_pairs(spark, odd, empty):
    prepared(spark)
    rows = [(i, f"{t}\n{t[:200]}\nshort line") for i, t in varied(9, 60, 40, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {(i, k): line for i, t in rows for k, line in enumerate(t.split("\n"))}
    sets = {p: frozenset(t[k : k + 9] for k in range(len(t) - 8)) for p, t in texts.items()}
    links = [
        (a, b) for a, b in itertools.combinations(sorted(texts), 2)
        if texts[a] == texts[b] or len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]) > 0
    ]
    want = smallest_reachable(texts, links)
    got = {(r["doc_id"], r["line_no"]): (r["first_doc"], r["first_line"]) for r in lines.line_fates(docs).collect()}
    assert got == want
    assert lines.without_repeats(odd).columns == odd.columns
    assert lines.line_fates(empty).count() == lines.without_repeats(empty).count() == 0


def test_short_lines_link(spark):
    prepared(spark)
    rng = random.Random(14)
    rows = ["Subscribe to updates", "Subscribe to updates!", "tiny", "tiny!", "x" * 12, "x" * 300, "abcabcabcabc", "abc" * 90]
    for _ in range(60):
        base = "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(9, 60)))
        rows += [base, base + rng.choice("xyz"), rng.choice("xyz") + base[1:], base + "some more of it"[: rng.randrange(15)]]
    rows += ["Copyright 20" + str(k) for k in range(10, 60)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [frozenset(t[k : k + 9] for k in range(len(t) - 8)) for t in rows]
    links = [
        (a, b) for a, b in itertools.combinations(range(len(rows)), 2)
        if rows[a] == rows[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0
    ]
    got = {r["doc_id"]: r["first_doc"] for r in lines.line_fates(docs).collect()}
    assert got == smallest_reachable(range(len(rows)), links)
    assert got[1] == 0 and got[3] == 3 and got[5] == 4


def test_long_lines_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdé😀 ") for _ in range(n)) for n in (0, 9, 39, 40, 41, 500, 3000)]
    whole = lines.least_hashes(texts)
    for step in (7, 64, 1000):
        monkeypatch.setattr(lines, "STEP", step)
        assert (lines.least_hashes(texts) == whole).all()
    hashes = lines.window_hashes(texts[-1])
    assert len(hashes) == 2992 and all(
        whole[-1][k] == min((h >> 6 for h in hashes.tolist() if h % 64 == k), default=2**64 - 1) for k in range(64)
    )
    assert [len(k) for k in lines.band_keys(texts).to_pylist()][:3] == [0, 0, 0]


def test_media_round_trip_and_store(spark, odd, empty):
    prepared(spark)
    rng = random.Random(10)
    base = " ".join(f"w{rng.randrange(90000)}" for _ in range(3000))
    rows = [(1, base), (2, "front " + base), (3, base), (4, None), (5, "é" * 3000), (6, ""), (7, " ".join(f"alone{rng.randrange(90000)}" for _ in range(2000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    catalogue, store = media.store_media(docs)
    got = {r["doc_id"]: r for r in catalogue.join(media.read_media(store), "media").collect()}
    for i, text in rows:
        data = (text or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
        assert (got[i]["n_bytes"], got[i]["payload_sha256"]) == (len(data), hashlib.sha256(payload).hexdigest())
        assert got[i]["tail_crc32"] == zlib.crc32(payload[-16:])
    kept = sum(c["length"] for r in store.collect() for c in r["chunks"] if c["owned"])
    assert kept < 1.5 * len(base) + 7000 + len(rows[6][1])  # the shifted copy shares nearly all chunks
    catalogue, store = media.store_media(odd)
    assert catalogue.join(media.read_media(store), "media").count() == len(ODD)
    catalogue, store = media.store_media(empty)
    assert catalogue.join(media.read_media(store), "media").count() == 0


def test_near_duplicates_against_all_pairs(spark, odd, empty):
    prepared(spark)
    rows = varied(11, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, links)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(sets[i]) for i in sets)
    found = neardup.near_duplicates(odd).collect()
    assert len(found) == len(ODD) and {r["doc_id"]: r["component_id"] for r in found}[5] == 1
    assert neardup.near_duplicates(empty).count() == 0


def test_every_coordinate_fills():
    import numpy as np

    for n in (1, 2, 50, 5000):
        elements = neardup.mixed(np.arange(1, n + 1, dtype=np.uint64))
        assert (neardup.sketch(elements, 384) < np.iinfo(np.uint64).max).all()
    a, b = neardup.mixed(np.arange(0, 1000, dtype=np.uint64)), neardup.mixed(np.arange(200, 1200, dtype=np.uint64))
    same = (neardup.sketch(a, 4096) == neardup.sketch(b, 4096)).mean()
    assert abs(same - 800 / 1200) < 0.04


def test_pipeline_keeps_columns(spark, odd, empty):
    import corpus_pipeline

    for docs in (odd, empty):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, docs, "")
            if name != "packing":
                assert out.columns == docs.columns, name
            assert docs is not empty or out.count() == 0


def test_pipeline_drops_copies_by_row(spark):
    import corpus_pipeline

    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base), (1, base), (None, base + " end"), (None, None), (2, ""), (2, ""), (3, "alone and short"), (4, "start " + base), (5, " ".join(f"v{i}" for i in range(80)))]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _at long")
    left = sorted(r["_at"] for r in corpus_pipeline.drop_copies(spark, docs, "").collect())
    assert len([i for i in left if i in (0, 1, 2, 7)]) == 1
    assert set(left) >= {3, 4, 5, 6, 8}
