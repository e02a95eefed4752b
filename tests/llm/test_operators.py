"""The operators on small tables: brute force, round trips, and the defined results for odd rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonloom.llm import chat, jaccard, language, licenses, media, mixing, packing, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 2 else "de", [None, "a", "b"][i % 3], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("taken", F.lit("clash")).withColumn("node", F.lit(1)) if extra else df


ODD = [None, "", "   \n\t", "one", "one two", "ß é 漢字", "one two three four five six " * 400, "one", "one"]


def test_licenses_find_exact_and_edited_notices(spark):
    texts = ["see the MIT License, and the mit-license", "Licensed under teh Apache Licence, Version 2.0.", "nothing here", *ODD]
    rows = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts, extra=True)).collect()}
    assert (rows[0]["n_base"], rows[0]["first_word"], rows[0]["last_word"], rows[0]["base_labels"]) == (2, 2, 6, "mit")
    assert rows[1]["n_base"] == 0 and rows[1]["labels"] == "" and rows[2]["score"] == 0.0
    assert licenses.Scanner().scan("x licensed under the apache license versin 2 0 y")["labels"] == "apache,apache-2.0"
    near = licenses.Scanner().scan("a licensed undr the apache licence version 2 0 b")
    assert near["labels"] == "apache-2.0" and near["spans"][0]["edits"] == 2 and near["spans"][0]["first_word"] == 1
    assert rows[3]["n_words"] == 0 and rows[3]["first_word"] is None
    assert licenses.scan(docs(spark, [])).count() == 0


def test_toxicity_holds_the_words_of_one_text_at_a_time():
    import tracemalloc

    texts = [" ".join("word" + "abcdefghij"[(i + k) % 10] for k in range(200)) for i in range(500)] + [None, ""]
    tracemalloc.start()
    sizes, word, before = toxicity.numbered(texts, toxicity.Hashes())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 45 * len(word)  # a string for every word alone takes more
    assert sizes.tolist() == [200] * 500 + [0, 0] and len(set(word.tolist())) == 10 and (before[:2] == [0, word[0]]).all() and before[200] == 0


def test_toxicity_learns_words_and_keeps_odd_rows(spark):
    rng = np.random.default_rng(0)
    plain = "the of and to in is it as at by for from on or with was".split()
    texts = [" ".join(rng.choice(plain, 60)) for _ in range(400)]
    toxic = [i % 4 == 0 for i in range(400)]
    texts = [t.replace(" with ", " vile ", 2).replace(" was ", " vile ", 2) if bad else t for t, bad in zip(texts, toxic)]
    table = docs(spark, [*texts, *ODD], extra=True)
    labels = spark.createDataFrame([(i, 1, int(x)) for i, x in enumerate(toxic)] + [(3, None, None)], "doc_id long, quality int, toxic int")
    scorer = toxicity.fit(table, labels)
    rows = {r["doc_id"]: r for r in toxicity.score(table, scorer).collect()}
    assert len(rows) == 400 + len(ODD)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i]["held_out"] for i in held)
    assert np.mean([rows[i]["predicted"] == int("vile" in texts[i]) for i in held]) > 0.95
    none = toxicity.score(table, toxicity.fit(table, labels.filter("doc_id < 0")))
    assert {r["score"] for r in none.collect()} == {0.0}


def toxic_model(spark, rows, **settings):
    labelled = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    return toxicity.learn(toxicity.word_counts(labelled), toxicity.pair_counts(labelled), **settings)


def test_toxicity_keeps_rare_words_in_any_number_of_shards(spark, monkeypatch):
    letters = ["".join("abcdefghij"[int(c)] for c in f"{i:04}") for i in range(3000)]
    rows = [(" ".join(letters), 0)] * 400 + [(" ".join(letters), 1)] * 40
    rows += [("seldom", 1)] * 5 + [("rarely", 1), *[("tame", 0)] * 5, *[("plenty", 0)] * 400, *[("plenty", 1)] * 40]
    one, many = toxic_model(spark, rows), toxic_model(spark, rows, shard_words=700)
    monkeypatch.setattr(toxicity, "HELD_WORDS", 10)
    word = np.array([toxicity.Hashes()[w] for w in ("seldom", "rarely", "plenty", "tame", "unseen", "aaaa")], np.int64)
    gains = [e.gains(word, np.full_like(word, 7)) for e in (one, many)]
    assert len(list(many.shards(many.words_path, False))) == 5 and many.words_path not in many.held
    assert gains[0] == pytest.approx(gains[1])
    seldom, rarely, plenty, tame, unseen, _ = gains[1]
    assert seldom > rarely > 0.1 > plenty > tame and unseen == 0


def test_toxicity_gains_equal_a_plain_computation(spark):
    rng = np.random.default_rng(3)
    vocabulary = "the of and to in is you are such an odd".split()
    rows = [(" ".join(rng.choice(vocabulary[i % 3 :], 12)), int(i % 3 == 0)) for i in range(40)] + [("such you the odd", 1), (None, 1), ("", 0)]
    shrink, trust_half = 3.0, 2.0
    model = toxic_model(spark, rows, shrink=shrink, pair_shrink=trust_half)
    counts, pairs, buckets, hashes = (Counter(), Counter(), Counter()), (Counter(), Counter(), Counter()), {}, toxicity.Hashes()
    for text, bad in rows:
        words = (text or "").split()
        for kind in (bad, 2):
            counts[kind].update(words)
            pairs[kind].update(zip(["", *words], words))
        for h, w in zip(["", *words], words):
            x = (hashes[h] if h else 0) % 2**64
            zeros = 64 if not x else (x & -x).bit_length() - 1
            buckets.setdefault(w, set()).add((min(7, zeros // 3), x >> 58))
    n, d = [sum(c.values()) for c in counts], 0.75
    free = [sum(min(x, d) for x in c.values()) / m for c, m in zip(counts, n)]
    followed = {w: sum(-64 * math.log(1 - sum(level == k for level, _ in b) / 64) for k in range(8)) for w, b in buckets.items()}
    shared = {w: (counts[2][w] - d) / n[2] + free[2] * followed[w] / sum(followed.values()) for w in followed}
    logs = {}
    for w in followed:
        a = 1 / (1 + (shrink / counts[2][w]) ** 2)
        logs[w] = [a * math.log(max(counts[k][w] - d, 0) / n[k] + free[k] * shared[w]) + (1 - a) * math.log(shared[w]) for k in (0, 1)]
    once, twice = (sum(x == k for x in pairs[2].values()) for k in (1, 2))
    cut = once / (once + 2 * twice) if once else d

    def after(k, h, w, below):
        own = [x for (g, _), x in pairs[k].items() if g == h]
        return (max(pairs[k][h, w] - cut, 0) + sum(min(x, cut) for x in own) * below) / sum(own) if own else below

    for h, w in pairs[2]:
        both = after(2, h, w, shared[w])
        plain, bad = (math.log(after(k, h, w, both * math.exp(logs[w][k]) / shared[w])) for k in (0, 1))
        a = 1 / (1 + (trust_half / pairs[2][h, w]) ** 2)
        want = a * (bad - plain) + (1 - a) * (logs[w][1] - logs[w][0])
        got = model.gains(np.array([hashes[w]], np.int64), np.array([hashes[h] if h else 0], np.int64))
        assert got[0] == pytest.approx(want), (h, w)
    unseen = model.gains(np.array([hashes["odd"]], np.int64), np.array([hashes["never"]], np.int64))
    assert unseen[0] == pytest.approx(logs["odd"][1] - logs["odd"][0])


def test_toxicity_estimates_any_number_of_words_before(spark):
    rng = np.random.default_rng(2)
    for n in (3, 100, 5000, 400_000):
        level, one = toxicity.bits_of(rng.integers(-(2**63), 2**63 - 1, n))
        bits = [int(np.bitwise_or.reduce(one[level == k], initial=0)) for k in range(toxicity.LEVELS)]
        got = spark.createDataFrame([tuple(bits)], ", ".join(f"{c} long" for c in toxicity.LANES)).select(toxicity.followed().alias("n")).first()["n"]
        assert 0.5 * n < got < 1.8 * n


def test_toxicity_hears_expressions_of_ordinary_words(spark):
    rng = np.random.default_rng(1)
    plain = "the of and to in is it as at by for from on or with was".split()
    rows = []
    for i in range(400):
        words = list(rng.choice(plain, 60))
        words[20:20] = ["as", "was"] * 3 if i % 4 == 0 else ["was"] * 3 + ["as"] * 3
        rows.append((" ".join(words), int(i % 4 == 0)))
    model = toxic_model(spark, rows)
    (bad, good) = model.of(["as was as was", "was was as as"])
    assert bad[0] > good[0] + 0.1


def test_toxicity_counts_all_rows_that_do_not_calibrate(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "learn", lambda counts, pairs, stems: seen.extend((r["word"] for r in counts.collect())) or seen.append(pairs.count()))
    letters = ["".join("abcdefghij"[int(c)] for c in str(i)) for i in range(400)]
    hashes = toxicity.Hashes()
    table = docs(spark, letters)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    toxicity.fit(table, labels, calibration_rows=20)
    *found, n_pairs = seen
    folds = {hashes[w]: zlib.crc32(str(i).encode()) % 4 for i, w in enumerate(letters)}
    fold3 = [w for w, f in folds.items() if f == 3]
    assert {w for w, f in folds.items() if f < 2} <= set(found) and not any(folds[w] == 2 for w in found)
    assert len(fold3) - 40 <= len(set(fold3) & set(found)) < len(fold3) and n_pairs == len(found)
    seen.clear()
    toxicity.fit(table, labels, calibration_rows=20, pair_words=50)
    assert 50 < seen[-1] < 150 and len(seen) == len(found) + 1


def test_toxicity_looks_up_pairs_by_shuffles_as_in_held_tables(spark, monkeypatch):
    rng = np.random.default_rng(5)
    letters = ["".join("abcdefghij"[int(c)] for c in str(i)) for i in range(300)]
    texts = [" ".join(rng.choice(letters[: 30 + i], 1 + i)) + (" foul deed" if i % 3 == 0 else "") for i in range(200)] + [None, "", "new words alone", "!", "foul deed", "foul deed"]
    table = docs(spark, texts, extra=True).repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "ASKED_BYTES", 2000)
    monkeypatch.setattr(toxicity, "GROUPS", 7)
    monkeypatch.setattr(toxicity, "SHARD_WORDS", 64)
    found = []
    for most in (1 << 40, 0):
        monkeypatch.setattr(toxicity, "HELD_PAIRS", most)
        scorer = toxicity.fit(table, labels)
        assert (scorer.groups is None) == (most > 0) and (scorer.evidence.pairs_path is None) == (most == 0)
        rows = {r["doc_id"]: r["x"] for r in toxicity.measured(table, scorer.evidence, scorer.groups).collect()}
        found.append((rows, {r["doc_id"]: r["score"] for r in toxicity.score(table, scorer).collect()}))
    (held, held_scores), (dealt, dealt_scores) = found
    assert len(held) == len(dealt) == len(texts)
    for i in held:
        assert dealt[i] == pytest.approx(held[i], abs=1e-6) and dealt_scores[i] == pytest.approx(held_scores[i], abs=1e-4)


def test_toxicity_counts_every_pair_and_calibrates_on_every_row_of_fold_3(spark, monkeypatch):
    letters = ["".join("abcdefghij"[int(c)] for c in f"{i:05}") for i in range(30_000)]
    table = docs(spark, letters[:20_000] + [" ".join(letters[20_000 + k :: 100] * 600) for k in range(100)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20_100)], "doc_id long, quality int, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "logistic", lambda *rows: seen.update(n=len(rows[0]) if isinstance(rows[0], np.ndarray) else rows[0].count()))
    monkeypatch.setattr(toxicity, "pair_counts", lambda drawn: seen.update(held=drawn.count()), raising=False)
    counted = toxicity.counted_groups
    monkeypatch.setattr(toxicity, "counted_groups", lambda *a: seen.setdefault("groups", counted(*a)))
    toxicity.fit(table, labels)
    folds = [zlib.crc32(str(i).encode()) % 4 for i in range(20_100)]
    assert "held" not in seen and seen["n"] == folds.count(3) > 4500
    single, long = sum(f < 2 for f in folds[:20_000]), sum(f < 2 for f in folds[20_000:])
    assert long * 60_000 > 2_500_000 and seen["groups"].counts.agg(F.sum("n")).first()[0] == single + 101 * long


def test_toxicity_fits_by_sums_as_on_all_rows_at_once(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(3, 2, (500, 4))
    y = (rng.random(500) < 1 / (1 + np.exp(-(x - 3) @ [1.0, -0.5, 0.2, 0.0]))).astype(int)
    rows = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y)], "x array<double>, toxic int").repartition(5)
    centre, scale, w = toxicity.logistic(rows)
    z = np.c_[(x - x.mean(0)) / (x.std(0) + 1e-9), np.ones(500)]
    slope = z.T @ (y - 1 / (1 + np.exp(-z @ w))) - 1e-2 * w
    assert centre == pytest.approx(x.mean(0)) and scale == pytest.approx(x.std(0)) and np.abs(slope).max() < 1e-5
    assert toxicity.logistic(rows.filter("toxic = 1")) is None and toxicity.logistic(rows.limit(0)) is None


def test_toxicity_stage_drops_what_the_query_predicts(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = docs(spark, ["some text", "other text"])
    for prior, predicted in ((0.4, 1), (0.2, 0)):
        monkeypatch.setattr(toxicity, "fit", lambda *_, prior=prior: toxicity.Scorer(None, None, prior))
        assert {r["predicted"] for r in toxicity.score(table, toxicity.fit()).collect()} == {predicted}
        assert toxicity.stage(spark, table, str(tmp_path)).count() == 2 * (1 - predicted)


def test_toxicity_stage_and_query_agree_where_pairs_are_looked_up_by_shuffles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD_PAIRS", 0)
    rng = np.random.default_rng(8)
    plain = "the of and to in is it as at by for from on or with was".split()
    texts = [" ".join(rng.choice(plain, 40)) + (" vile scum" if i % 4 == 0 else "") for i in range(200)]
    table = docs(spark, [*texts, *ODD], extra=True)
    table = table.union(table.limit(3))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = toxicity.score(table, toxicity.fit(table, labels)).collect()
    kept = toxicity.stage(spark, table, str(tmp_path))
    assert kept.columns == table.columns and 20 < sum(r["predicted"] for r in rows) < 100
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if not r["predicted"])
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_mixing_meets_targets_and_bounds(spark):
    texts = [" ".join(["w"] * (1 + i % 50)) for i in range(600)] + ODD
    rows = mixing.mix(docs(spark, texts, extra=True), block_words=4, docs_per_shard=100).collect()
    assert len(rows) == len(texts) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for source in (None, "a", "b"):
        own = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.02)
        assert own[0]["target"] <= 2 * own[0]["source_size"] + 1e-6
    total = sum(r["size"] for r in rows)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(1.5 * total)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixing_targets_equal_a_filling_by_rounds(spark):
    sizes = {None: 10, "a": 1000, "b": 100, "c": 5, "d": 4000, "e": 1, "f": 900}
    rows = spark.createDataFrame([(s or "", s, float(n)) for s, n in sizes.items()], "skey string, source string, source_size double")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, target = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in target]
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        target |= {s: 2 * sizes[s] for s in over}
    assert got == pytest.approx(target)


def test_mixing_stage_keeps_clashing_columns_and_reruns_agree(spark):
    table = docs(spark, [f"w {i} " * (1 + i % 5) for i in range(60)] + ODD).withColumn("_id", F.lit(1)).withColumn("_COPIES", F.lit(2)).withColumn("_copy", F.lit(3))
    first, second = (sorted(tuple(r) for r in mixing.stage(spark, table, "").select("doc_id", "_id", "_COPIES", "_copy").collect()) for _ in range(2))
    assert first == second and first and {r[1:] for r in first} == {(1, 2, 3)}
    assert mixing.stage(spark, docs(spark, []), "").count() == 0


def test_sainte_lague_equals_highest_quotients(spark):
    votes = [53, 24, 23, 1, 0, 7, 7]
    df = spark.createDataFrame([(i, v, s) for i, v in enumerate(votes) for s in [0]], "p long, v long, g long")
    for seats in (1, 5, 10, 37):
        got = {r["p"]: r["quota"] for r in mixing.sainte_lague(df.withColumn("s", F.lit(seats).cast("long")), ["g"], "v", "s").collect()}
        want = [0] * len(votes)
        for _ in range(seats):
            want[max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert sum(got.values()) == seats and all(abs(got[i] - want[i]) <= 1 for i in got)
        assert sorted(v / (2 * got[i] + 1) for i, v in enumerate(votes)) == pytest.approx(sorted(v / (2 * w + 1) for v, w in zip(votes, want)))


def test_chat_folds_edits_and_regenerations(spark):
    events = spark.createDataFrame(
        [(1, 1, 1, "open", "user", ""), (1, 1, 2, "delta", "user", "<s>[x]&amp;"), (1, 2, 3, "open", "assistant", None), (1, 2, 4, "delta", "assistant", "bad"), (1, 2, 5, "regenerate", "assistant", None)]
        + [(1, 2, 6, "delta", "assistant", "a"), (1, 2, 7, "delta", "assistant", "b<|end|>"), (1, 1, 8, "edit", "user", "new &lt;"), (2, 1, 1, "open", None, None)],
        "conv_id long, message long, seq long, op string, role string, text string",
    )
    rows = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(events))).collect()}
    assert [tuple(t) for t in rows[1]["turns"]] == [("user", "new &lt;"), ("assistant", "ab<|end|>")]
    assert rows[1]["loss_text"] == "ab<|end|>" and [tuple(t) for t in rows[2]["turns"]] == [("", "")]
    assert rows[1]["formatted"].count("<|end|>") == 2


def test_media_round_trip(spark):
    rows = media.store(docs(spark, [*ODD, "x" * 500], extra=True)).collect()
    for r, text in zip(sorted(rows, key=lambda r: r["doc_id"]), [*ODD, "x" * 500]):
        raw = (text or "").encode()
        back = media.from_wav(bytes(r["media"]))
        assert back[: len(raw)] == raw and len(back) == r["payload_bytes"] == max(192, -(-len(raw) // 192) * 192)
        assert hashlib.sha256(back).hexdigest() == r["payload_sha256"] and len(r["times"]) == len(r["codes"])
    assert len({r["payload_sha256"] for r in rows if r["doc_id"] in (3, 7, 8)}) == 1


def test_media_fingerprint_equals_brute_force():
    rng = np.random.default_rng(6)
    payload = bytes(rng.integers(0, 256, 192 * 40).astype(np.uint8))
    window = np.hanning(media.FRAME).astype(np.float32)
    peaks = []
    for frame in range((len(payload) - media.FRAME) // media.HOP + 2):
        x = np.full(media.FRAME, 128, np.uint8)
        part = np.frombuffer(payload, np.uint8)[frame * media.HOP : frame * media.HOP + media.FRAME]
        x[: len(part)] = part
        x = x.astype(np.float32)
        mag = np.abs(np.fft.rfft((x - x.mean()) * window))[1:]
        tops = [(-mag[i], i) for i in range(1, len(mag) - 1) if mag[i] > mag[i - 1] and mag[i] >= mag[i + 1] and mag[i] > 1e-3]
        peaks += [(frame, i + 1) for _, i in sorted(tops)[: media.PEAKS]]
    want = sorted((t, (f << 17) | (g << 10) | (u - t)) for k, (t, f) in enumerate(peaks) for u, g in peaks[k + 1 : k + 1 + media.FAN * media.PEAKS] if 0 < u - t <= media.AHEAD)
    times, codes = media.fingerprint(payload, window)
    assert list(zip(times.tolist(), codes.tolist())) == want and len(want) > 100


def test_licenses_equal_a_whole_text_search_and_stay_linear():
    import time

    import regex

    rng = np.random.default_rng(8)
    scanner = licenses.Scanner()
    for _ in range(60):
        words = []
        for _ in range(6):
            phrase = list(rng.choice(list(licenses.NOTICES)))
            for _ in range(int(rng.integers(0, 4))):
                phrase[int(rng.integers(len(phrase)))] = rng.choice(list("abc "))
            words += ["some", "words", "".join(phrase)]
        text = " ".join(" ".join(words).split())
        found = {label for label, *_ in scanner.fuzzy(f" {text} ", licenses.Spaces(f" {text} "))}
        want = {label for phrase, label in licenses.NOTICES.items() if regex.search(rf"(?<![^ ])(?:{regex.escape(phrase, literal_spaces=True)}){{e<={licenses.ERRORS}}}(?![^ ])", f" {text} ")}
        assert found == want
        for label, a, b, edits, _ in scanner.fuzzy(f" {text} ", licenses.Spaces(f" {text} ")):
            assert edits <= licenses.ERRORS and 0 <= a <= b < len(text.split())
    start = time.time()
    assert scanner.scan("mit license " * 90_000)["n_base"] == 90_000
    assert time.time() - start < 20


def test_packing_covers_every_id_once(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma,"], int(n))) for n in rng.integers(0, 3000, 120)] + ODD
    encoded = packing.encode(docs(spark, texts, extra=True)).cache()
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u2") for r in encoded.collect()}
    from public_tokenizers import path
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("word_bpe_49k.json"))
    for i, t in enumerate(texts):
        assert ids[i].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 1]
    pieces = packing.pack(encoded).collect()
    seen, used = {}, {}
    for r in pieces:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.astype("<u4").tobytes()) == r["ids_crc32"]
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found, size in ((seen, lambda k: len(ids[k])), (used, lambda k: None)):
        for k, spans in found.items():
            at = 0
            for start, n in sorted(spans):
                assert start == at
                at += n
            assert size(k) is None or at == size(k)
    assert all(sum(n for _, n in s) <= packing.LENGTH for s in used.values()) and set(seen) == set(ids)


def test_column_generation_finds_the_optimum():
    # classes 81 and 87 need 200 sequences, 51s fit with neither and go in pairs, 41s fit beside the 87s: 250
    demand = np.zeros(128, int)
    demand[[40, 50, 80, 86]] = [100, 100, 100, 100]
    patterns = packing.patterns_for(demand, 128)
    assert np.allclose(sum(p * x for p, x in patterns), demand) and sum(x for _, x in patterns) == pytest.approx(250)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "ß" * 5000), (None, "n", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read(warc.archive(pages, str(tmp_path)), str(tmp_path)).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2)}
    assert got[5]["payload_bytes"] == 10000 and got[5]["payload_digest"] == warc.digest_of(("ß" * 5000).encode())
    assert warc.read(warc.archive(pages.limit(0), str(tmp_path / "e")), str(tmp_path / "e")).count() == 0


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vecs = rng.integers(-3, 4, (300, 8)).astype(float) / 256
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)] + [(400, None), (450, [1.0, None]), (451, [float("nan")]), (7, vecs[7].tolist())]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(topk.blocks_of(df, 16), df.filter("vec_id % 50 = 0"), most=1).collect()}
    ids = [*range(300), 7]
    ints = np.floor(vecs[ids] * 256).astype(int)
    for q in range(0, 300, 50):
        best = sorted(((-int(ints[q] @ ints[j]), ids[j]) for j in range(len(ids)) if ids[j] != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_jaccard_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for n in (4, 6, 9, 12, 20, 40, 150):
        for _ in range(6):
            base = list(rng.choice(words, n + 3))
            texts.append(" ".join(base))
            for edits in (0, 1, 2):
                copy = list(base)
                for _ in range(edits):
                    copy[int(rng.integers(len(copy)))] = "edit"
                texts.append(" ".join(copy) + (" tail" if edits == 1 else ""))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set()) for w in ((t or "").lower().split() for t in texts)]
    low = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
        if all(low[low[i]] == low[i] for i in range(len(low))):
            break
    rows = jaccard.join(docs(spark, texts, extra=True)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(s), low[i]) for i, s in enumerate(sets)}


def test_jaccard_stage_equals_brute_force_by_its_own_rule(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (6, 10, 30, 47, 100, 100, 230):
        base = list(rng.choice(words, n, replace=False))
        texts += [" ".join(base), " ".join(base[: n - n * 17 // 100]), " ".join(base + [f"new{i}" for i in range(n * 24 // 100)])]
        for changes in range(n // 49 + 1, n // 40 + 2):
            copy = list(base)
            for i in range(changes):
                copy[(2 * i + 1) * n // (2 * changes)] = "edit"
            texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (t.split() for t in texts)]
    low = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
    kept = {r["doc_id"] for r in jaccard.stage(spark, docs(spark, texts), "").collect()}
    assert kept == {i for i in range(len(texts)) if low[i] == i}


def test_jaccard_stage_goes_by_content_where_ids_are_null_or_repeated(spark):
    base = [" ".join(f"{letter}{i}" for i in range(100)) for letter in "abcdef"]
    rows = [(None, base[0]), (None, base[1]), (None, base[0] + " tail"), (1, base[2]), (1, base[3]), (2, base[4]), (3, base[4]), (3, base[5]), (1, base[2]), (None, None), (4, None), (4, "")]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = [(r["doc_id"], r["text"]) for r in jaccard.stage(spark, table, "").collect()]
    assert len(kept) == 9 and len(set(kept)) == 9 and len({(None, base[0]), (None, base[0] + " tail")} & set(kept)) == 1
    assert {(None, base[1]), (1, base[2]), (1, base[3]), (2, base[4]), (3, base[5]), (None, None), (4, None), (4, "")} <= set(kept)


def test_jaccard_keys_grow_with_the_set():
    rng = np.random.default_rng(11)
    for n in (400, 3000):
        sizes = np.arange(n, n * 13 // 10, n // 20)
        keys = jaccard.keys_of(np.concatenate([np.sort(rng.integers(0, 2**63, k).astype(np.uint64) * np.uint64(2)) for k in sizes]), sizes, jaccard.Bands(80))[1]
        assert len(keys) < sizes.sum()


def test_jaccard_words_and_shingles_are_those_of_the_rule(monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 16)  # cuts between words, and words longer than a chunk
    texts = ["a b c d e", None, "", " \t\n", "A  b\x0bC d\re ", "x" * 50 + " y z " + "w" * 40 + "\u00df", "one two", "one\u00a0two three", "a b c d a b c d a b c d", "two one"]
    shingler = jaccard.Shingler(3)
    tokens, sizes = shingler.sets(jaccard.pa.array(["skipped", *texts]).slice(1))
    words = [(t or "").lower().encode().split() for t in texts]
    want = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()) for w in words]
    assert sizes.tolist() == [len(x) for x in want]
    ends = np.cumsum(sizes)
    name, back = {}, {}
    for text, end, n in zip(want, ends, sizes):
        own = set(tokens[end - n : end].tolist())
        for shingle in text:
            name.setdefault(shingle, own)
            name[shingle] = name[shingle] & own
        for token in own:
            back.setdefault(token, text)
            back[token] = back[token] & text
    assert all(name.values()) and all(back.values())  # the same shingle has the same token in all texts, and no other


def test_jaccard_buckets_may_span_batches(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 3
    for i in range(40):
        copy = list(base)
        copy[int(rng.integers(60))] = f"edit{i % 7}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"v{i}x{j}" for j in range(30)) for i in range(10)] * 2
    want = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs(spark, texts), 1, 85).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs(spark, texts), 1, 85).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want == {i: 0 if i < 43 else 43 + (i - 43) % 10 for i in range(63)}


def test_jaccard_tells_clashing_names_apart(spark, monkeypatch):
    texts = [" ".join(f"{letter}{i}" for i in range(40)) for letter in "abcd"] + [" ".join(f"a{i}" for i in range(40))] + [" ".join([*(f"b{i}" for i in range(40)), "tail"])]
    plain = jaccard.names_of
    monkeypatch.setattr(jaccard, "names_of", lambda tokens, sizes: (plain(tokens, sizes)[0] * 0 + 7, plain(tokens, sizes)[1]))
    rows = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs(spark, texts)).collect()}
    assert rows == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 1}


def test_jaccard_verifies_few_pairs_of_a_large_loose_group(spark, monkeypatch):
    # 2,000 copies of one text, pairs of which share 60 to 84 percent: no links, and no pair table
    rng = np.random.default_rng(13)
    base = np.array([f"w{i}" for i in range(300)], dtype=object)
    texts = []
    for i in range(2000):
        copy = base.copy()
        copy[rng.choice(300, int(rng.integers(8, 14)), replace=False)] = [f"e{i}x{j}" for j in range(20)][: 1]
        texts.append(" ".join(copy))
    counted, plain = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, sets, percent: counted.append(pairs.count()) or plain(pairs, sets, percent))
    rows = jaccard.join(docs(spark, texts)).collect()
    sets = [{tuple(w[i : i + 4]) for i in range(297)} for w in (t.split() for t in texts[:40])]
    shares = [len(x & y) / len(x | y) for i, x in enumerate(sets) for y in sets[:i]]
    assert max(shares) < 0.85 and len({r["component_id"] for r in rows}) > 1900
    assert sum(counted) < 4000


def test_jaccard_bucket_names_nodes_and_not_their_pairs(spark):
    # 300 nodes alike by sketch, each a component of its own, and one of another sketch: one group, not a row a pair
    rows = [(1, i, i, 100, bytearray(32), [7] if i == 3 else None) for i in range(300)] + [(1, 900, 900, 100, bytearray(b"\xff" * 32), None)]
    table = spark.createDataFrame(rows, "key long, node long, comp long, n long, sketch binary, past array<long>")
    got = jaccard.neighbours(table, "all", 80).collect()
    assert [sorted(r["nodes"]) for r in got] == [list(range(300))]


@pytest.mark.parametrize("block", [1 << 20, 6000, 500])
def test_jaccard_links_within_parts_equal_brute_force(spark, block):
    rng = np.random.default_rng(17)
    sets = {}
    for part in range(2):
        base = rng.choice(2**60, 60, replace=False).astype(np.uint64)
        for i in range(60):
            own = rng.choice(2**60, int(rng.integers(3, 12)), replace=False).astype(np.uint64)
            sets[part * 100 + i] = np.unique(np.concatenate([base[rng.permutation(60)[: 60 - int(rng.integers(0, 6))]], own]))
    tokens, sizes = np.concatenate(list(sets.values())), np.array([len(x) for x in sets.values()])
    sketches = dict(zip(sets, jaccard.sketches_of(tokens, sizes, 80)))
    comp = {i: i - i % 3 if i < 20 else i for i in sets}
    rows = spark.createDataFrame([(i, comp[i], len(x), bytearray(sketches[i]), i // 100) for i, x in sets.items()], "node long, comp long, n long, sketch binary, part long")
    table = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()] * 2, "node long, tokens binary")
    got = [(r["a"], r["b"]) for r in jaccard.linked_within(rows, table, 80, block).collect()]
    links = {(i, j) for i in sets for j in sets if i < j and i // 100 == j // 100 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert {(min(p), max(p)) for p in got} <= links and (block < 1 << 20 or len(got) < len(sets) < len(links))

    def parts(pairs):
        low = dict(comp)
        for _ in low:
            for a, b in pairs:
                x, y = low[a], low[b]
                low = {k: min(x, y) if v in (x, y) else v for k, v in low.items()} if x != y else low
        return low

    assert parts(got) == parts(links) and 2 < len(set(parts(got).values())) < len(set(comp.values()))


def test_jaccard_ends_equal_brute_force_near_the_limit(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "NEAREST", 0)
    monkeypatch.setattr(jaccard, "BLOCK", 4000)
    rng = np.random.default_rng(19)
    texts = []
    for group in range(3):
        for i in range(60):  # copies differ in 9 to 14 of 120 shingles each: some pairs link, more just do not
            copy = [f"g{group}w{k}" for k in range(124)]
            for k in rng.choice(range(124), int(rng.integers(2, 4)), replace=False):
                copy[k] = f"e{i}x{k}"
            texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    low = list(range(len(texts)))
    pairs = [(j, i) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for a, b in pairs * 3:
        x, y = sorted((low[a], low[b]))
        low = [x if v == y else v for v in low]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs(spark, texts), 5, 80).collect()}
    assert got == dict(enumerate(low))


def test_jaccard_leaves_a_common_passage_out_of_its_buckets(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"d{i}x{j}" for j in range(140)) for i in range(600)]
    texts += [t + " tail" for t in texts[:20]]
    found = jaccard.buckets(docs(spark, texts))
    rows = found.filter("key is not null").select("key", "a")
    feats = jaccard.features(docs(spark, texts)).select("node", "spares")
    left = jaccard.spared(rows, feats.distinct()).groupBy("key").count().agg(F.max("count")).first()[0] or 0
    assert rows.groupBy("key").count().agg(F.max("count")).first()[0] > jaccard.HOT >= left
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs(spark, texts)).collect()}
    assert got == {i: i if i < 600 else i - 600 for i in range(620)}


def test_parity_sketch_bounds_the_difference():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:-20], rng.integers(0, 2**63, 10).astype(np.uint64)])
    x, y = jaccard.sketches_of(np.concatenate([a, b]), np.array([len(a), len(b)]))
    for width in (len(x), 32):
        assert np.bitwise_count(jaccard.unsketched(x, width) ^ jaccard.unsketched(y, width)).sum() <= 30


def test_language_by_fewest_phrases(spark):
    english = ["the cat sat on the mat and the dog ran in the park with them"] * 30
    german = ["die katze sitzt auf der matte und der hund lief durch den garten"] * 30
    df = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate([(e, "en") for e in english] + [(g, "de") for g in german])], DOCS)
    model = language.fit(df)
    got = model.predict(["the dog sat on the cat", "der hund auf der katze", "123 --", None, "", "THE MAT " * 5000])
    assert [g[0] for g in got] == ["en", "de", "und", "und", "und", "en"] and all(0 <= g[1] <= 1 for g in got)
    codes = model.coder.encode("the dog sat")
    text = "\n".join(dict.fromkeys(english))
    phrases, at, known = 0, 0, model.coder.encode(text).tobytes()
    while at < len(codes):
        n = 1
        while at + n < len(codes) and codes[at : at + n + 1].tobytes() in known:
            n += 1
        phrases, at = phrases + 1, at + n
    assert model.phrases([codes])[0][model.langs.index("en")] == phrases
    assert {r["lang_pred"] for r in language.identify(df, language.fit(df.limit(0))).collect()} == {"und"}


def test_language_knows_every_letter_of_its_sample():
    rng = np.random.default_rng(9)
    latin, greek, cyrillic = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    han, kana = "".join(chr(0x4E00 + i) for i in range(600)), "".join(chr(0x3041 + i) for i in range(80))
    samples, tests = {}, {}
    for name, letters in {"la": latin, "el": greek, "ru": cyrillic, "zh": han[:400], "ja": kana + han[300:], "zz": latin}.items():
        words = ["".join(rng.choice(list(letters), 4)) for _ in range(80)]
        samples[name], tests[name] = " ".join(rng.choice(words, 600)), " ".join(rng.choice(words, 12))
    model = language.Model(samples)
    got = model.predict(list(tests.values()))
    assert [g[0] for g in got] == list(tests) and min(g[1] for g in got) > 0.5
    for name, text in tests.items():  # phrases by the definition
        code = {c: chr(int(c) + 1) for c in range(model.coder.size)}
        whole, known = ("".join(code[int(c)] for c in model.coder.encode(t)) for t in (text, samples[name]))
        phrases = at = 0
        while at < len(whole):
            n = 1
            while at + n < len(whole) and whole[at : at + n + 1] in known:
                n += 1
            phrases, at = phrases + 1, at + n
        assert model.phrases([model.coder.encode(text)])[0][model.langs.index(name)] == phrases


def test_language_keeps_all_labelled_languages(spark):
    name = lambda i: "".join("bcdfghjklm"[int(c)] for c in f"{i:03}")
    table = docs(spark, [f"{name(i)} a{name(i)}e {name(i)}o" for i in range(300)]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string")))
    train = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    more = table.union(table.withColumn("doc_id", F.col("doc_id") + 1000)).union(table.withColumn("doc_id", F.col("doc_id") + 2000)).union(table.withColumn("doc_id", F.col("doc_id") + 3000)).union(table.withColumn("doc_id", F.col("doc_id") + 4000))
    model = language.fit(more)
    assert len(model.langs) > 256 and {f"l{i}" for i in train} <= set(model.langs)
    assert model.predict([f"a{name(7)}e {name(7)}o", f"{name(299)} a{name(299)}e"])[0][0] == "l7"
