"""The training-data operators against brute force, and on odd inputs."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvine.llm import _common, license_scan, lm_score, media, mixing, ngram_join, packing, quality_rules, token_counts, toxicity, url_filter
from corvine.llm._common import FOLDED, Slots, find_words, hash_words, text_arrays
from corvine.llm.queries import URL_RULES, fold, tokenizer_path

DDL = "doc_id long, text string, source string, lang string, word string, n long, key long, size long, h string"
LONG = "alpha beta gamma delta " * 40_000
ODD = [
    (1, None, None, None, "a", 1, 1, 1, "x"),
    (2, "", "s1", "en", "b", 2, 2, 2, "x"),
    (3, " \n\t\x0b ", "s1", "en", None, None, None, None, None),
    (4, "One two, three four five six. L'été 😀 ▁ \u3000 <|endoftext|>", "s2", "fr", "c", 3, 3, 3, "x"),
    (4, "One two, three four five six. L'été 😀 ▁ \u3000 <|endoftext|>", "s2", "fr", "c", 3, 3, 3, "x"),
    (5, "same words in this text here now", "s1", None, "d", 4, 4, 4, "x"),
    (6, "same words in this text here now", "s2", None, "e", 5, 5, 5, "x"),
    (7, LONG, None, "en", "f", 6, 6, 6, "x"),
    (8, "x", "s3", "en", "g", 7, 7, 7, "x"),
    (None, "no id at all but some words", "s3", "en", "g", 7, 7, 7, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def words(text):
    return (text or "").encode().lower().split()


def test_word_hashes_agree_with_words():
    texts = ["A b  a\tB", None, "", "É é\nx", "end", " lead"]
    data, offsets = text_arrays(pa.array(texts, pa.string()))
    starts, ends, rows = find_words(data, offsets)
    flat = [w for t in texts for w in words(t)]
    assert [data[a:b].tobytes().lower() for a, b in zip(starts, ends, strict=True)] == flat
    assert rows.tolist() == [i for i, t in enumerate(texts) for _ in words(t)]
    hashes = hash_words(data, starts, ends, FOLDED).tolist()
    assert len(set(hashes)) == len(set(flat)) and dict(zip(flat, hashes, strict=True)) == {w: h for w, h in zip(flat, hashes, strict=True)}


def test_slots_find_what_was_added():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 3000).astype(np.uint64))
    table = Slots(13)
    table.add(keys[::2], np.arange(len(keys[::2])))
    assert table.find(keys[::2]).tolist() == list(range(len(keys[::2])))
    assert (table.find(keys[1::2]) == -1).all()


def test_spread_join_equals_the_plain_join(spark):
    left = spark.createDataFrame([(k, i) for k, n in ((1, 500), (2, 3), (3, 1), (4, 40), (9, 2)) for i in range(n)], "k long, v long")
    right = spark.createDataFrame([(1, 500, "a"), (2, 3, "b"), (3, 1, "c"), (4, 40, "d"), (7, 0, "e")], "k long, n long, w string")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right.drop("n"), "k", how).collect()))
        for most in (0, 99):
            assert sorted(map(str, _common.spread_join(left, right, "k", "n", how, most).collect())) == want


def test_lm_score(spark, odd, empty):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "of", f"w{rng.randint(0, 300)}", "and"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    learn = lambda i: F.coalesce(fold(i, 7) != 2, F.lit(True))
    got = lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), learn).collect()
    streams = {i: [*words(t), None] for i, t in rows}
    counts = Counter(w for i, s in streams.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in s)
    total, distinct = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        s = streams[r["doc_id"]]
        base = sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in s)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(s), sum(counts[w] > 0 for w in s), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    out = lm_score.score_documents(odd, learn).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ODD)
    assert all(r["n_tokens"] == 1 for r in out if r["doc_id"] in (1, 2, 3))
    assert lm_score.score_documents(empty, learn).count() == 0


def trained_model(seed, words=400, leaves=8):
    rng = np.random.default_rng(seed)
    names = rng.choice(2**62, words + 60, replace=False).astype(np.uint64) + np.uint64(1)
    counts = np.sort(rng.integers(2, 900, words))[::-1]
    leaf = lm_score.leaf_of(names[words:], leaves)
    model = lm_score.Model(names[:words], counts, np.bincount(leaf, minlength=leaves) * 1.0, np.bincount(leaf, minlength=leaves), int(counts.sum()) + 60, len(names), bits=12)
    stream = rng.choice(names, 900)
    stream[[299, 699, 899]] = lm_score.END
    edges = np.array([0, 300, 300, 700, 900])
    model.learn(stream, edges, np.ones(len(model.table), np.float32))
    return model, names, stream, edges


def brute_path(model, rank):
    return list(zip(model.of[model.edges[rank] : model.edges[rank + 1]].tolist(), model.digit[model.edges[rank] : model.edges[rank + 1]].tolist(), strict=True))


def brute_chance(model, history, rank):
    """P of a path by plain loops over features and choices; ``history`` is the last three tokens, nearest first."""
    full, chance = 2**64 - 1, 1.0
    a, b, c = history
    odd = [int(x) for x in lm_score._ODD]
    keys = [a * odd[0] & full, (a ^ (b << 1 & full)) * odd[1] & full, b * odd[2] & full, c * odd[3] & full]
    for of, digit in brute_path(model, rank):
        salt = (of * odd[2] + odd[1]) & full
        rows = [((k ^ salt) * odd[0] & full) >> (64 - model.bits) for k in keys]
        total = [np.exp(float(model.bias[of, j]) + sum(float(model.table[r, j]) for r in rows)) for j in range(lm_score.ARITY)]
        chance *= total[digit] / sum(total)
    return chance


def test_lm_scores_are_the_brute_force_softmax():
    model, names, stream, edges = trained_model(1)
    assert np.abs(model.table).max() > 0.05
    logs, target = model.score(stream, edges)
    end = int(lm_score.END)
    rank = {int(w): i for i, w in enumerate(model.head)}
    for text in zip(edges[:-1], edges[1:], strict=True):
        for at in range(*text):
            back = [int(stream[at - k]) if at - k >= text[0] else end for k in (1, 2, 3)]
            word = int(stream[at])
            own = rank.get(word, len(model.head) + (word >> 20) % len(model.leaf_once))
            assert target[at] == own and 10 ** logs[at] == pytest.approx(brute_chance(model, back, own), rel=1e-4)


def test_lm_probabilities_sum_to_one():
    model, names, _, _ = trained_model(0)
    history = [int(names[3]), int(names[7]), int(names[1])]
    assert sum(brute_chance(model, history, i) for i in range(len(model.head) + len(model.leaf_once))) == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("counts", [[5], [3, 3], [1] * 9, [1000, 1, 1, 1], list(range(5000, 0, -1)), [10**9] + [1] * 70])
def test_lm_class_paths_tell_words_apart(counts):
    edges, of, digit, sums = lm_score.cut_classes(np.array(counts, float))
    paths = [tuple(zip(of[a:b].tolist(), digit[a:b].tolist(), strict=True)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    assert len(set(paths)) == len(counts) and all(p[0][0] == 0 for p in paths) and max(map(len, paths)) <= 12
    assert not any(a != b and a == b[: len(a)] for a, b in zip(paths, paths[1:], strict=False))
    assert sums[0].sum() == pytest.approx(sum(counts))


def test_lm_head_cut_and_growth(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([9, 9, 7, 7, 7, 2, 1, 1, 1, 1])], "word long, n long")
    assert [lm_score.head_count(counts, m) for m in (0, 1, 2, 4, 5, 6, 9, 10, 99)] == [10, 10, 9, 9, 7, 2, 2, 1, 1]
    assert lm_score.head_count(counts.where("false"), 5) == 1
    for grow in (lm_score.head_size, lambda v: lm_score.ARITY ** lm_score.leaf_digits(v), lambda v: 1 << lm_score.row_bits(v)):
        assert grow(10**4) < grow(10**7) < grow(10**10)


def test_lm_words_beyond_the_head(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "head_size", lambda v: 3)
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(i % 9)) + " the the of") for i in range(200)] + [(300, "w1 w1 zz zz zz")]
    learn = lambda i: i < 150
    got = {r["doc_id"]: r for r in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), learn).collect()}
    counts = Counter(w for i, t in rows if i < 150 for w in [*t.split(), None])
    total, distinct = sum(counts.values()), len(counts)
    for i, t in rows:
        s = [*t.split(), None]
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in s))
        assert got[i]["n_known"] == sum(counts[w] > 0 for w in s)
    assert got[300]["score"] < 0


def test_lm_equal_and_null_ids(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e f g"), (None, "a b"), (None, None)]
    out = lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), lambda i: F.lit(True)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out) == [("1", 4), ("1", 4), ("1", 5), ("None", 1), ("None", 3)]


def shingled(n, a="a", b="b"):
    """Thue-Morse words: a polynomial hash modulo a power of two confuses the two of a length."""
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_word_hashes_tell_thue_morse_words_apart():
    for n in (3, 5, 10, 12):
        data = " ".join(shingled(n)).encode()
        starts, ends, _ = find_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        one, two = hash_words(np.frombuffer(data, np.uint8), starts, ends).tolist()
        assert one != two


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://A.example.com/en/x?q#f", "https://www.EXAMPLE.com/en/1", "http://b.net/es/", "http://b.net", "x://q.org/en/9", "http://q.org#f/g", "http://ccom/"]
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(frame, URL_RULES).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in range(10)] == [("", ""), ("", ""), ("", ""), ("a.example.com", "/en/x"), ("www.example.com", "/en/1"), ("b.net", "/es/"), ("b.net", ""), ("q.org", "/en/9"), ("q.org", ""), ("ccom", "/")]
    assert [got[i]["rule"] for i in range(10)] == [None, None, None, "example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None]
    assert {got[i]["verdict"] for i in range(10)} <= {"allow", "block"}
    assert url_filter.judge_urls(frame.where("false"), URL_RULES).count() == 0


def test_url_model_learns_its_labels(spark):
    rng = random.Random(5)
    rows = [(i, f"http://{rng.choice('abc')}.{'good.com/en/' if i % 2 else 'spam.net/es/'}{rng.randint(0, 99)}") for i in range(600)]
    rows += [(1000 + i, f"http://{rng.choice('abc')}.{'good.org/en/' if i % 2 else 'spam.org/es/'}{rng.randint(0, 99)}") for i in range(100)]
    out = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).where("rule is null").collect()
    assert np.mean([(r["verdict"] == "allow") == bool(r["page_id"] % 2) for r in out]) > 0.9


def test_url_scores_are_exact_whatever_the_number_of_keys(spark):
    rng = random.Random(6)
    name = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=28))
    rows = [(i, f"http://{'good.com' if i % 2 else 'spam.net'}{'/en/' if i % 2 else '/es/'}{name()}") for i in range(6000)]
    rows += [(10_000 + i, f"http://else.org/{name()}") for i in range(40)]
    out = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    addresses = spark.createDataFrame([(i, u[7:]) for i, u in rows], "id long, address string").select("id", "address", F.pmod(F.xxhash64("address"), F.lit(5)).alias("fold")).collect()
    counts = [Counter(), Counter()]
    for r in addresses:
        if r["id"] < 10_000 and r["fold"]:
            a = r["address"]
            for order in range(url_filter.ORDER + 1):
                for at in range(order, len(a)):
                    counts[r["id"] % 2].update([(a[at - order : at], ""), (a[at - order : at], a[at])])
    assert min(map(len, counts)) > 1 << 18

    def loglik(a, count):
        total = 0.0
        for at in range(len(a)):
            chance = 1 / 256
            for order in range(min(url_filter.ORDER, at) + 1):
                context = a[at - order : at]
                chance = (count[context, a[at]] + url_filter.BACKOFF * chance) / (count[context, ""] + url_filter.BACKOFF)
            total += float(np.log(chance))
        return total

    for r in addresses[-40:] + addresses[:10]:
        a = r["address"]
        assert out[r["id"]]["score"] == pytest.approx((loglik(a, counts[1]) - loglik(a, counts[0])) / len(a), abs=1e-9)


def test_best_threshold_splits_and_breaks_ties():
    assert url_filter.best_threshold([(-10, 0, 5), (20, 1, 5)]) == 0
    assert url_filter.best_threshold([(10, 0, 5), (20, 1, 5)]) == 11 * url_filter.BIN
    assert url_filter.best_threshold([(3, 1, 5)]) == 0


def quality(text):
    w = [x for x in (text or "").encode().split()]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark, odd, empty):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aab  \n#é\t") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    frame = spark.createDataFrame([(i, t, f"s{i % 3}", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, host long")
    for r in quality_rules.judge_documents(frame).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == quality(texts[r["doc_id"]])
    out = quality_rules.judge_documents(odd).collect()
    assert len(out) == len(ODD) and not any(r["kept"] for r in out if r["doc_id"] in (1, 2, 3))
    assert quality_rules.judge_documents(empty).count() == 0


def test_hosts_that_mostly_fail_are_rejected(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good if i % 10 else "short", "fine") for i in range(100)] + [(100 + i, good if i % 10 == 0 else good + " #" * 40, "bad") for i in range(100)] + [(200, "short", "tiny"), (201, good, "tiny")]
    out = quality_rules.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["host"]: r["host_ok"] for r in out} == {"fine": True, "bad": False, "tiny": True}
    assert all(r["kept"] for r in out if r["host"] == "fine" and r["n_words"] == 80)


def test_token_counts(spark, odd, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    counter = token_counts.SegmentCounter(path)
    rng = random.Random(6)
    texts = [None, "", LONG] + ["".join(rng.choice(["a", " ", "  ", "\n", "é", "字", "😀", "▁", "<s>", "the "]) for _ in range(rng.randint(0, 20))) for _ in range(2000)]
    expected = [len(x) for x in counter.encode([t or "" for t in texts])]
    assert counter.counts(*text_arrays(pa.array(texts, pa.string()))).tolist() == expected
    out = token_counts.count_tokens(odd, path, 4096).collect()
    assert len(out) == len(ODD) and {r["n_tokens"] for r in out if r["doc_id"] in (1, 2)} == {0}
    assert [r["over_limit"] for r in out if r["doc_id"] == 7] == [True]
    assert token_counts.count_tokens(empty, path, 1).count() == 0


def weak_hash(data, starts, ends, fold=None):
    """Nearly all spans collide."""
    return ((ends - starts) % 3 + 1).astype(np.uint64)


def test_colliding_hashes_confuse_no_tokens(monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["one", "two", "six", "extraordinarily", "extraordinarilz", "a" * 40, "a" * 39 + "b", "it's", "\u3000x", *shingled(10)]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    arrays = text_arrays(pa.array(texts))
    monkeypatch.setattr(token_counts, "hash_words", weak_hash)
    monkeypatch.setattr(packing, "hash_words", weak_hash)
    counter = token_counts.SegmentCounter(tokenizer_path("piece_bpe_32k.model"))
    words_ = packing.WordIds(tokenizer_path("word_bpe_49k.json"))
    for _ in range(2):
        assert counter.counts(*arrays).tolist() == [len(x) for x in counter.encode(texts)]
        ids, edges = words_.encode(*arrays)
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [e.ids for e in words_.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_encode_whole_texts():
    words_ = packing.WordIds(tokenizer_path("byte_bpe_50k.json"))
    assert not words_.splits
    texts = ["The cat  sat", "", "on  the\nmat. it's"]
    ids, edges = words_.encode(*text_arrays(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [e.ids for e in words_.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert packing.WordIds(tokenizer_path("word_bpe_49k.json")).splits


def test_targets_by_water_filling(spark):
    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, None: 500}, {"a": 0, "b": 7}, {}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
        weight, free, left, want = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set(names), sum(sizes.values()), {}
        while free:
            share = left / sum(weight[s] for s in free)
            if not (over := [s for s in free if share * weight[s] > 3 * sizes[s] + 1e-9]):
                want |= {s: share * weight[s] for s in free}
                break
            for s in over:
                want[s], left = 3 * sizes[s], left - 3 * sizes[s]
            free -= set(over)
        assert {r["source"]: r["target"] for r in mixing.targets(frame).collect()} == pytest.approx(want)


def test_hypergeometric_draws(spark):
    import math

    uniform = (F.col("id") + 0.5) / 4000
    cols = [mixing.hypergeometric(F.lit(n).cast("bigint"), F.lit(k).cast("bigint"), F.lit(m).cast("bigint"), uniform).alias(f"c{i}") for i, (n, k, m) in enumerate(((50, 20, 10), (7, 7, 3), (9, 0, 4), (1000, 300, 500)))]
    out = spark.range(4000).select(*cols).toPandas()
    exact = lambda n, k, m: {x: math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m) for x in range(max(0, m + k - n), min(k, m) + 1)}
    for i, (n, k, m) in enumerate(((50, 20, 10), (7, 7, 3), (9, 0, 4), (1000, 300, 500))):
        seen = out[f"c{i}"].value_counts(normalize=True).to_dict()
        assert all(abs(seen.get(x, 0) - p) < 2e-3 for x, p in exact(n, k, m).items())


def test_split_keeps_quotas(spark):
    quotas = [0, 3, 17, 400, 1]
    got = mixing.split_quotas(spark.createDataFrame([(quotas,)], "quotas array<long>"), 8, 5).collect()
    assert [sum(r["blocks"] for r in got if r["place"] == i) for i in range(5)] == quotas
    shards = [sum(r["blocks"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(shards) - min(shards) <= 1


def test_mixing(spark, odd, empty):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 90))), f"s{min(int(rng.expovariate(0.4)), 6)}", 9) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, words long")
    one, two = (sorted((r["doc_id"], r["mix_size"], r["mix_target"], tuple(p["shard"] for p in r["mix_places"])) for r in mixing.mix(frame.repartition(k)).collect()) for k in (2, 5))
    assert one == two and len(one) == 900
    source = {i: s for i, _, s, _ in rows}
    taken, target = Counter(), {}
    for i, size, goal, places in one:
        assert size == len(words(rows[i][1])) and len(places) <= 3
        taken[source[i]] += size * len(places)
        target[source[i]] = goal
    assert all(abs(taken[s] - t) <= max(10, 0.01 * t) for s, t in target.items())
    assert len(mixing.mix(odd).collect()) == len(ODD)
    assert mixing.mix(empty).count() == 0


def png():
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_media_sniffing(spark):
    import gzip

    wave, gif = media.to_wave(b"12345678"), b"GIF89a" + bytes(7) + b"\x2c" + bytes(9) + b"\x02\x01\x44\x00;"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x03xdata\xff\xd9"
    for value, kind in ((png(), "image/png"), (wave, "audio/wav"), (gif, "image/gif"), (jpeg, "image/jpeg"), (gzip.compress(b"x" * 99), "application/gzip")):
        assert media.sniff(value) == (kind, [])
        mixed = b"head" + value + b"tail"
        assert media.sniff(mixed) == (media.UNKNOWN, [(kind, 4, len(value))])
        assert media.sniff(value[:-1])[0] == media.UNKNOWN
    assert media.sniff(media.to_wave(png()))[1][0][0] == "image/png"
    assert media.from_wave(wave) == b"12345678"
    assert media.sniff(b"") == media.sniff(b"GIF89a GIF89a BM RIFF PK\x03\x04 %PDF-1.4") == (media.UNKNOWN, [])
    frame = spark.createDataFrame([(1, bytearray(png()), "image/gif"), (2, None, None), (3, bytearray(b"zz"), "text/plain")], "id long, value binary, kind string")
    out = {r["id"]: r for r in media.sniff_column(frame, "value", "kind", ["id"]).collect()}
    assert (out[1]["media_type"], out[1]["corrected"], out[2]["media_type"], out[3]["corrected"]) == ("image/png", True, media.UNKNOWN, False)


def streamed_zip(**options):
    """An archive whose member headers leave sizes to descriptors."""
    import io
    import zipfile

    class Pipe(io.RawIOBase):
        data = b""

        def writable(self):
            return True

        def write(self, part):
            self.data += bytes(part)
            return len(part)

    pipe = Pipe()
    with zipfile.ZipFile(pipe, "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("a.txt", "b.txt"):
            with z.open(name, "w", **options) as f:
                f.write(name.encode() * 50)
    return pipe.data


def pdf(body=b"", base=b""):
    """A file, or an update of one, whose end tells the place of its cross-references."""
    new = base + (b"\n" if base else b"%PDF-1.4\n") + body + b"\n"
    return new + b"xref\n0 1\n0000000000 65535 f \ntrailer <<>>\nstartxref\n%d\n%%%%EOF" % len(new)


def test_media_zip_with_descriptors_and_pdf_ends():
    import io
    import zipfile

    for archive in (streamed_zip(), streamed_zip(force_zip64=True)):
        assert archive[6] & 8
        assert media.sniff(archive) == ("application/zip", [])
        assert media.sniff(b"head" + archive + b"tail") == (media.UNKNOWN, [("application/zip", 4, len(archive))])
        assert media.sniff(archive[:-1])[0] == media.UNKNOWN
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", archive)
    assert media.sniff(outer.getvalue()) == ("application/zip", [("application/zip", 36, len(archive))])
    two = archive + outer.getvalue()
    assert media.sniff(two) == ("application/zip", [("application/zip", 0, len(archive)), ("application/zip", len(archive), len(two) - len(archive))])

    one, other = pdf(b"1 0 obj"), pdf(b"longer body of another file")
    assert media.sniff(one) == media.sniff(pdf(b"new", one)) == ("application/pdf", [])
    kind = "application/pdf"
    for second in (other, one):
        assert media.sniff(one + second) == (kind, [(kind, 0, len(one)), (kind, len(one), len(second))])
        mixed = one + png() + second
        assert media.sniff(mixed)[1] == [(kind, 0, len(one)), ("image/png", len(one), len(png())), (kind, len(one) + len(png()), len(second))]
    holds = pdf(b"stream " + other + b" endstream", one)
    assert media.sniff(b"x" + holds)[1] == [(kind, 1, len(holds))]
    loose = b"%PDF-1.4\nbody\nstartxref\n7\n%%EOF"
    assert media.sniff(loose + loose)[1] == [(kind, 0, len(loose)), (kind, len(loose), len(loose))]
    assert media.sniff(b"%PDF-1.4\ncut off" + one)[1] == [(kind, 16, len(one))]


def test_media_work_is_linear():
    import time

    tricks = [b"%PDF-1.4 ", b"%PDF-1.4 xref\nstartxref\n9\n%%EOF ", b"GIF89a\x00\x00\x00\x00\x00\x00\x00!a!", b"GIF89a,,,,,,,,,,", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x03x", b"PK\3\4PK\5\6", b"RIFF    WAVEfmt ", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR", b"startxref ", b"1 0 obj<<", b"BM"]
    for trick in tricks:
        began = time.perf_counter()
        media.sniff(trick * (4_000_000 // len(trick)))
        assert time.perf_counter() - began < 30, trick


def test_media_web_layout_and_updates_of_a_pdf():
    head = b"%PDF-1.5\nfirst page "
    first = head + b"xref\n0 1\ntrailer\nstartxref\n0\n%%EOF\nrest of the file\nstartxref\n%d\n%%%%EOF" % len(head)
    assert media.sniff(first) == ("application/pdf", [])
    assert media.sniff(b"ab" + first + b"cd")[1] == [("application/pdf", 2, len(first))]
    body = b"%PDF-1.5\nbody "
    stream = body + b"7 0 obj << /Size 3 /Type /XRef >> stream endstream\nstartxref\n%d\n%%%%EOF" % len(body)
    assert media.sniff(b"x" + stream + b" ")[1] == [("application/pdf", 1, len(stream))]


def test_media_columns_on_odd_rows(spark):
    rows = [(1, None, None), (1, bytearray(b""), "image/png"), (2, bytearray(png()), None), (2, bytearray(png()), None), (3, bytearray(b"GIF89a" * 200_000 + png()), "x")]
    frame = spark.createDataFrame(rows, "id long, value binary, kind string")
    out = media.sniff_column(frame, "value", "kind", ["id"]).collect()
    assert sorted((r["id"], r["media_type"], bool(r["corrected"]), len(r["carved"])) for r in out) == [(1, media.UNKNOWN, False, 0)] * 2 + [(2, "image/png", True, 0)] * 2 + [(3, media.UNKNOWN, False, 1)]
    assert media.sniff_column(frame.where("false"), "value", "kind", ["id"]).count() == 0
    with pytest.raises(ValueError, match="media_type"):
        media.sniff_column(frame.withColumnRenamed("id", "media_type"), "value", "kind", ["media_type"])


def test_media_query_corrects_declared_types(spark, monkeypatch):
    from corvine.llm.queries import op6_media

    seen = []

    def sniff_column(frame, value, declared, keys, real=media.sniff_column):
        seen.append(real(frame, value, declared, keys))
        return seen[-1]

    monkeypatch.setattr(media, "sniff_column", sniff_column)
    out = op6_media(spark, "/root/testdata/sf0.001").collect()
    assert len(out) and all(r["feature"].startswith("audio/wav") and r["payload_bytes"] >= r["n_bytes"] for r in out)
    assert {(r["declared_type"] == "audio/wav", r["media_type"], r["corrected"]) for r in seen[0].collect()} == {(False, "audio/wav", True)}


def test_license_scan(spark, odd, empty):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, f"{mit}", "a/x.txt"), (2, "plain", "a/b/y.txt"), (3, f"{gpl}\n" + "word " * 200, "a/b/z.txt"), (4, gpl, "a/b/LICENSE"), (5, "plain", "a/b/c/w.txt"), (6, "plain", "q/w.txt"), (7, None, None), (8, "the mit license plate was under the sofa of all rights", "a/k.txt"), (9, "plain", "top.txt")]
    out = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, path string"), "path").collect()}
    assert {i: out[i]["license"] for i in out} == {1: "MIT", 2: "GPL-3.0", 3: "GPL-3.0", 4: "GPL-3.0", 5: "GPL-3.0", 6: None, 7: None, 8: "MIT", 9: None}
    assert {i: out[i]["inherited_from"] for i in (2, 3, 5, 8)} == {2: "a/b", 3: None, 5: "a/b", 8: "a"}
    assert license_scan.scan(odd.withColumn("path", F.col("source")), "path").count() == len(ODD)
    assert license_scan.scan(empty.withColumn("path", F.col("source")), "path").count() == 0


def test_license_scan_of_wrapped_headers_files_and_notices_beside_other_text(spark):
    apache = '# Licensed under the Apache License, Version 2.0 (the\n# "License"); you may not use this file\n# except in compliance with the License.\n\ndef f(): pass'
    mit = "The MIT License (MIT)\n\nCopyright (c) 2020 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal in the Software\nwithout restriction, subject to the following conditions:"
    beside = "Released under the MIT License. Contact the author for more details about using this software."
    unknown = "Licensed under the Apache License, Version 2.0. " + " ".join(f"unknown{i}" for i in range(12))
    want = {
        1: (apache, "Apache-2.0"), 2: (mit, "MIT"), 3: (beside, "MIT"), 4: (unknown, "Apache-2.0"), 5: ("Copyright (c) 2020 Jane Doe. All rights reserved.", "Proprietary"),
        6: ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), 7: ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        8: ("This library is free software; you can redistribute it\nand/or modify it under the terms of the GNU Lesser General\nPublic License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
        9: ("GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991\n\nbody " * 1, "GPL-2.0"), 10: ("The version of the license was granted to a person of the public.", None), 11: ("word " * 30000, None),
    }
    rows = [(i, text, f"d{i}/f") for i, (text, _) in want.items()]
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, path string"), "path").collect()
    assert {r["doc_id"]: r["own_license"] for r in out} == {i: name for i, (_, name) in want.items()}


def test_lines_without_anchors_are_below_the_threshold():
    idf, vectors = license_scan.template_weights()
    found = set(license_scan.anchors(vectors, license_scan.THRESHOLD))
    assert all(sum(v * v for w, v in vector.items() if w not in found) < license_scan.THRESHOLD**2 for _, vector in vectors)


def brute_components(texts, t=75, n=5):
    sets = {}
    for i, text in texts:
        w = words(text)
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
        if not changed:
            break
    return {i: (len(sets[i]), label[i]) for i in sets}


def near_texts(seed, n=150):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 5000)}"
    passage = " ".join(word() for _ in range(30))
    roots = [[word() for _ in range(rng.randint(20, 80))] for _ in range(8)]
    out = []
    for i in range(n):
        w = list(rng.choice(roots)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            if w:
                w[rng.randrange(len(w))] = word()
        text = " ".join(w)
        out.append((i, (text + " " + passage) if rng.random() < 0.3 else text.upper() if rng.random() < 0.1 else text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_is_exact(spark, seed, monkeypatch):
    texts = near_texts(seed)
    if seed == 2:  # groups walked in blocks, components closed in rounds
        monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 150)
        monkeypatch.setattr(ngram_join, "SMALL_EDGES", 0)
        monkeypatch.setattr(ngram_join, "BUCKET_ROWS", 500)
        monkeypatch.setattr(_common, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(_common, "HOT", 1 / 20)
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_classes(frame).collect()}
    assert got == brute_components(texts)


def test_ngram_join_links_all_in_large_batches(spark):
    """Batches of more rows than a packet numbers."""
    rng = random.Random(21)
    rows = [(i, f"x{i} {rng.random()} a{rng.random()} b{i} c{rng.random()} d{i}") for i in range(70_000)]
    pairs = 60
    for k in range(pairs):
        words_ = [f"p{k}q{j}" for j in range(40)]
        rows[k * 5] = (k * 5, " ".join(words_))
        rows[-1 - k * 3] = (rows[-1 - k * 3][0], " ".join(words_[:-1]))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows) and all(got[rows[-1 - k * 3][0]] == k * 5 for k in range(pairs))


def test_ngram_join_on_odd_rows(odd, empty):
    out = ngram_join.similar_classes(odd).collect()
    assert len(out) == len(ODD)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}
    assert [got[i] for i in (1, 2, 3)] == [(0, 1), (0, 2), (0, 3)] and got[5] == (3, 5) and got[6] == (3, 5) and got[8] == (1, 8)
    assert ngram_join.similar_classes(empty).count() == 0


@pytest.mark.parametrize("bridge", [[(4, 30)], [(None, 30)], [(None, 30), (None, 30)]])
@pytest.mark.parametrize("most", [0, 500_000])
def test_rows_without_ids_are_bridges(spark, monkeypatch, bridge, most):
    """The first and last text share two thirds only; each shares 0.8 and more with the one between them, whatever its id."""
    monkeypatch.setattr(_common, "BROADCAST_ROWS", most)
    text = lambda size: " ".join(f"w{i}" for i in range(size + 4))
    rows = [(5, text(36)), *((i, text(k)) for i, k in bridge), (3, text(24)), (None, "another text of some words here"), (None, None)]
    got = ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["n_shingles"] > 20) == [(24, 3), *[(30, 3)] * len(bridge), (36, 3)]
    assert {r["component_id"] for r in got if r["n_shingles"] <= 20} == {None}


def test_components_in_rounds(spark):
    rng = random.Random(9)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 540)]
    frame = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long")
    assert sorted(map(tuple, ngram_join.components(frame).collect())) == sorted(map(tuple, ngram_join.components_in_rounds(frame).collect()))


def toxic_rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"{rng.choice(['ba', 'lo', 'ri'])}{rng.choice(['na', 'to', 'me'])}{rng.randint(0, 30)}" for _ in range(rng.randint(20, 60))]
        bad = int(rng.random() < 0.3)
        for _ in range(bad * rng.randint(2, 4)):
            w[rng.randrange(len(w))] = rng.choice(["idiot", "vermin"]) + rng.choice(["", "s", "ish", "x"])
        out.append((i, " ".join(w), bad))
    return out


def test_toxicity(spark, odd, empty):
    rows = toxic_rows(900, 2)
    docs = spark.createDataFrame([(i, t, -1) for i, t, _ in rows] + [(None, None, 0), (5000, "", 0)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, b, "junk") for i, _, b in rows] + [(None, None, None)], "doc_id long, toxic int, text string")
    learn = lambda i: fold(i, 3) != 1
    score = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, labels, learn).collect()}
    held = [(score[i] >= 0.7, b) for i, _, b in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(score) == 902 and np.mean([p == b for p, b in held]) > 0.95
    assert score[5000] < 0.7 and all(0 <= s <= 1 for s in score.values())
    unseen = spark.createDataFrame([(1, "bana1 loto2 idiotical rime4 verminous idiotz idiotsx vermins" + " bato7" * 12)], "doc_id long, text string")
    assert toxicity.score_texts(docs.unionByName(unseen.withColumn("doc_id", F.lit(7000).cast("long")).withColumn("label", F.lit(0))), labels, learn).where("doc_id = 7000").first()["score"] >= 0.7
    assert toxicity.score_texts(odd, labels.where("false"), learn).where("score = 0").count() == len(ODD)
    assert toxicity.score_texts(empty, labels, learn).count() == 0


def test_toxicity_sample(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50) * 20, "c") for i in range(400)] + [(7, None, "c"), (None, "n", "c")], "doc_id long, text string, more string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, label int")
    rows = toxicity.sample(docs, marks, 30, 1 << 20).collect()
    order = [r["doc_id"] for r in spark.range(400).select(F.col("id").alias("doc_id"), F.xxhash64(F.col("id")).alias("h")).orderBy("h").collect()]
    for label in (0, 1):  # labelled ids without a document take no places
        assert {r["doc_id"] for r in rows if r["label"] == label} == set([i for i in order if i % 2 == label][:30])
    few = toxicity.sample(docs, marks, 30, 3000).collect()
    assert 0 < len(few) < len(rows) and {(r["doc_id"], r["text"]) for r in few} < {(r["doc_id"], r["text"]) for r in rows}


def test_toxicity_learns_from_long_texts(spark):
    rows = [(i, ("vermin idiot " if i % 2 else "kind word ") * 2000, i % 2) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.score_texts(docs, docs.select("doc_id", "toxic"), lambda i: F.lit(True), carry=("toxic",)).collect()
    assert all((r["score"] >= 0.5) == bool(r["toxic"]) for r in out)


def test_word_ids_are_the_librarys():
    words_ = packing.WordIds(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(7)
    parts = ["a", " ", "\n", "'S", "'t", "é", "É", "×", "x", "1", "<|endoftext|>", "<|ENDOFTEXT|>", "\u3000", "字", "😀", "\u0301", "it's", "the", "!!", "ß", "İ", "Σ", "²", "|", "\xa0", "12ab", "ªº"]
    texts = [None, "", LONG] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    ids, edges = words_.encode(*text_arrays(pa.array(texts, pa.string())))
    want = [e.ids for e in words_.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == want


def test_sum_of_squares_choice():
    packer, rng = packing.SumOfSquares(16), random.Random(1)
    for i in range(300):
        size, counts = rng.randint(1, 15), packer.open.copy()

        def cost(h, counts=counts, size=size):
            after = counts.copy()
            after[h] -= h > 0
            after[h + size] += h + size < 16
            return int((after[1:16] ** 2).sum())

        able = [0, *(h for h in range(1, 17 - size) if counts[h])]
        assert cost(packer.level(size)) == min(map(cost, able))
        packer.put(size, i)


def test_packing_pieces_are_the_documents_ids(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(13)
    texts = [" ".join(rng.choice(["alpha", "of", "xylophone", "it's", "42", "\u3000é"]) for _ in range(rng.choice([0, 3, 30, 200]))) for _ in range(150)]
    ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = packing.pack(frame, path, 1, window=128).collect()
    pieces = {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, own in enumerate(ids):
        assert [k for start, n in sorted(pieces[i]) for k in range(start, start + n)] == list(range(len(own)))
    filled = Counter()
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert all(n == 128 or n & (n - 1) == 0 for n in filled.values())


@pytest.mark.parametrize("sizes", [[], [5], [16], [100, 90, 3], [127, 126, 1, 2], [40] * 20, list(range(1, 128))])
def test_settling_open_sequences(sizes):
    open_ = [[(i, 0, np.arange(n, dtype="<u4").tobytes(), n)] for i, n in enumerate(sizes)]
    done = packing.settle([list(p) for p in open_], 128)
    got = [(key, start + k, v) for pieces in done for key, start, raw, _ in pieces for k, v in enumerate(np.frombuffer(raw, "<u4").tolist())]
    assert sorted(got) == [(i, k, k) for i, n in enumerate(sizes) for k in range(n)]
    lengths = [sum(len(p[2]) for p in pieces) // 4 for pieces in done]
    assert all(n == 128 or n & (n - 1) == 0 for n in lengths) and sum(n < 128 for n in lengths) <= 7


def test_packing_loses_nothing(spark, odd, empty):
    path = tokenizer_path("word_bpe_49k.json")
    rows = packing.pack(odd, path, 1, window=64).collect()
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for (key, total), pieces in docs.items():
        assert sum(n for _, n in pieces) == total * (2 if key == 4 else 1)
    for pieces in sequences.values():
        ends = [0]
        for at, n in sorted(pieces):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 64 and (ends[-1] == 64 or ends[-1] & (ends[-1] - 1) == 0)
    assert {r["doc_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert packing.pack(empty, path, 1).count() == 0
