"""Operators that learn: base values by brute force, held-out quality, recall against exact search; the pipeline."""

import itertools
import math
import os
import time
import tracemalloc
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assay.llm import decontam, langid, pitman_yor, simhash, word_pairs
from assay.llm.seating import unpack
from assay.storage import free_shuffles

from .conftest import SF


def test_language_held_out(docs):
    out = langid.identify(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    swapped = docs.withColumn("lang", F.when(langid.fold("doc_id", 5) == 0, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(swapped).collect()} == {r["doc_id"]: r["lang_pred"] for r in out}


def test_language_odd_rows(odd):
    out = {r["id_"]: r for r in langid.identify(odd.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))).withColumnRenamed("doc_id", "id_").collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 and out[i]["rejected"] for i in (1, 2, 3, 8))
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.filter("text is null or doc_id = 8").count() == 0
    assert langid.identify(odd.limit(0)).count() == 0
    nothing = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert nothing.filter("lang_pred <> 'und'").count() == 0


def test_language_letters_and_rare_languages(spark):
    """Number signs are no letters; a language of long texts only and hundreds of small languages are learned."""
    odd = spark.createDataFrame([(1, "½ ² Ⅳ ①"), (2, "½ a"), (3, "— … “”")], "doc_id bigint, text string")
    rng = np.random.default_rng(5)
    words = {i: ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(12)] for i in range(300)}
    speak = lambda i, n: " ".join(str(w) for w in rng.choice(words[i], n))
    rows = [(10 * i + k, speak(i, 30 if i else 6000), f"l{i:03d}") for i in range(300) for k in range(10)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.languages) == 300
    assert model.predict(speak(0, 5000))[0] == "l000"
    assert np.mean([model.predict(speak(i, 60))[0] == f"l{i:03d}" for i in range(300)]) >= 0.9
    out = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [out[i]["lang_pred"] == "und" for i in (1, 2, 3)] == [True, False, True] and out[1]["score"] == 0


def test_pitman_yor_base_and_held_out(docs):
    rows = docs.collect()
    words = {r["doc_id"]: [w for w in r["text"].encode().lower().split()] + [None] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    c = Counter(w for i in words if not held[i] for w in words[i])
    n, v = sum(c.values()), len(c)
    out = pitman_yor.score(docs, block_bytes=50_000).collect()
    for r in out:
        w = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), abs=1e-6)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert sum(r["score"] for r in out if r["held_out"]) > sum(r["base_score"] for r in out if r["held_out"])
    again = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs.repartition(3), block_bytes=50_000).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], rel=1e-4) for r in out)


def test_pitman_yor_probabilities_sum_to_one(spark):
    """Over the training vocabulary, the end and the one outcome for unknown words."""
    texts = ["a b a c", "b b d", "a e f g", "h a b", "c c a"]
    train = [(i, t) for i, t in enumerate(texts * 8) if zlib.crc32(str(i).encode()) % 10]
    probe = [10_000_000 + i for i in range(2000) if zlib.crc32(str(10_000_000 + i).encode()) % 10 == 0][:10]
    rows = train + list(zip(probe, [*"abcdefgh", "", "unseen"]))
    out = {r["doc_id"]: r["score"] for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    end = out[probe[8]]
    assert sum(10 ** (out[p] - end) for p in [*probe[:8], probe[9]]) + 10**end == pytest.approx(1, abs=2e-3)


def test_pitman_yor_spells_unseen_words(spark):
    """Gibberish is less likely than clean text; a longer unseen word less than its start; all one-word texts together at most one."""
    texts = ["the cat sat on the mat", "the dog ran to the cat", "a cat and a dog", "the mat is on the dog"]
    train = [(i, t) for i, t in enumerate(texts * 20) if zlib.crc32(str(i).encode()) % 10]
    probe = [i for i in range(10_000_000, 10_002_000) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    rows = train + list(zip(probe, ["the cat on a mat", "zqxv jjkw qqpz vvxk zzzq", "zq", "zqxvjjkwqqpz", "z" * 2000, ""]))
    out = {r["doc_id"]: r for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    clean, gibberish, short, long, huge, end = (out[p] for p in probe)
    assert clean["log10_prob"] > gibberish["log10_prob"] and clean["perplexity"] < gibberish["perplexity"]
    assert short["log10_prob"] > long["log10_prob"] > huge["log10_prob"] and math.isfinite(huge["log10_prob"])
    assert clean["log10_prob"] == pytest.approx(clean["score"]) and gibberish["log10_prob"] < gibberish["score"]
    assert short["perplexity"] == pytest.approx(10 ** (-short["log10_prob"] / 2))


def test_pitman_yor_odd_rows(odd):
    out = pitman_yor.score(odd)
    assert out.count() == odd.count()
    assert out.filter("n_tokens = 1").count() == 4 and out.filter("isnan(score) or score is null").count() == 0
    assert pitman_yor.score(odd.limit(0)).count() == 0


def _held_out_ids(n):
    found = (i for i in range(10_000_000, 20_000_000) if zlib.crc32(str(i).encode()) % 10 == 0)
    return [next(found) for _ in range(n)]


@pytest.mark.parametrize("part,hot", [(1 << 21, 1 << 22), (40, 1 << 22), (25, 6)])
def test_word_contexts_sum_to_one(spark, part, hot):
    """Over all texts of up to seven words, unknown words being one outcome; contexts in one part, in several, and split."""
    texts = ["a", "a b", "b", "c", "", "b a", "a b", "c a"]
    train = [(i, t) for i, t in enumerate(texts * 8) if zlib.crc32(str(i).encode()) % 10]
    every = [" ".join(w) for n in range(8) for w in itertools.product(["a", "b", "c", "unseen"], repeat=n)]
    rows = train + list(zip(_held_out_ids(len(every)), every))
    out = pitman_yor.score(spark.createDataFrame(rows, "doc_id bigint, text string"), order=2, part=part, hot=hot)
    assert out.filter("held_out").select(F.sum(F.pow(F.lit(10.0), "score"))).first()[0] == pytest.approx(1, abs=6e-3)
    assert out.filter("held_out").select(F.sum(F.pow(F.lit(10.0), "log10_prob"))).first()[0] < 1


def test_word_contexts_know_the_order(docs, spark):
    """The order of words counts, and other columns are those without contexts; known texts beat the base score."""
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    plain, paired = ({r["doc_id"]: r for r in pitman_yor.score(docs, block_bytes=50_000, order=o).collect()} for o in (1, 2))
    assert plain.keys() == paired.keys()
    assert all([plain[i][c] for c in columns] == [paired[i][c] for c in columns] for i in plain)
    assert all(plain[i]["base_score"] == pytest.approx(paired[i]["base_score"]) for i in plain)
    held = [r for r in paired.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    learned = [r for r in paired.values() if not r["held_out"] and r["n_tokens"] > 1]
    assert sum(r["log10_prob"] for r in learned) > sum(plain[r["doc_id"]]["log10_prob"] for r in learned)
    rows = [(i, "the cat sat on the mat") for i in range(40)] + list(zip(_held_out_ids(2), ["the cat sat on the mat", "mat the on sat cat the"]))
    out = {r["doc_id"]: r["log10_prob"] for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id bigint, text string"), order=2).collect()}
    straight, turned = (out[i] for i in _held_out_ids(2))
    assert straight > turned + 2


def test_word_contexts_odd_rows(odd, spark):
    out = pitman_yor.score(odd, order=2)
    assert out.count() == odd.count()
    assert out.filter("n_tokens = 1").count() == 4 and out.filter("isnan(score) or score is null or isnan(log10_prob)").count() == 0
    assert pitman_yor.score(odd.limit(0), order=2).count() == 0
    untrained = spark.createDataFrame([(i, "a b") for i in _held_out_ids(3)], "doc_id bigint, text string")
    assert pitman_yor.score(untrained, order=2).filter("log10_prob < 0 and train_tokens = 0").count() == 3


def test_word_contexts_keep_each_text_once(docs, monkeypatch, tmp_path):
    """On disk when texts are scored: their codes once, the words and what parts say; before, codes were written again with the pairs."""
    monkeypatch.setattr(pitman_yor, "new_path", lambda spark, label: f"file://{tmp_path}/{label}-{uuid.uuid4().hex}")
    out = pitman_yor.score(docs, block_bytes=50_000, order=2)
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["blocks", "seated", "served"]
    (blocks,) = tmp_path.glob("blocks-*")
    assert [p.name for p in blocks.glob("kind=*")] == ["kind=1"]
    assert out.count() == docs.count()


def test_shuffle_files_of_a_written_table_go(spark, tmp_path):
    """They stayed until the driver's JVM collected its garbage, beside the tables of later steps."""
    made = lambda: set(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(","))
    before = made()
    df = spark.range(100_000).repartition(4, "id").mapInArrow(lambda batches: batches, "id bigint")
    df.write.parquet(f"file://{tmp_path}/t")
    wrote = {p for p in made() - before if "shuffle_" in p}
    free_shuffles(spark)
    for _ in range(50):
        if not (left := {p for p in wrote if os.path.exists(p)}):
            break
        time.sleep(0.1)
    assert wrote and not left


def test_word_pairs_memory_of_a_block():
    rng = np.random.default_rng(5)
    n, tokens, texts = 50_000, 1_000_000, 1000
    codes, lengths = np.minimum(rng.zipf(1.2, tokens), n).astype(np.int64) - 1, np.full(texts, tokens // texts)
    numbers, counts = np.append(np.arange(1, n + 1), 0), np.append(np.bincount(codes, minlength=n), texts)
    tracemalloc.start()
    pairs = word_pairs.BlockPairs(codes, lengths, numbers, counts, 3, 1 << 22)
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 35 * tokens and kept < 11 * tokens  # before: 59 and 15 bytes a token
    first = np.insert(codes, np.cumsum(lengths), n)
    assert (pairs.w[pairs.step] == first).all() and (pairs.u[pairs.step] == np.concatenate(([n], first[:-1]))).all()


def test_word_pairs_against_plain_counts():
    """Parts merge the blocks' pairs: what a context gives away and what its words keep make up its customers."""
    rng = np.random.default_rng(3)
    words, parts, hot = 30, 7, 40
    blocks = [[rng.zipf(1.5, int(n)) % words for n in rng.integers(0, 60, 20)] for _ in range(5)]
    numbers = np.append(np.arange(1, words + 1) << 33, 0)
    counts = np.append(np.bincount(np.concatenate([t for b in blocks for t in b]), minlength=words), 100)
    plain = Counter((u, w) for b in blocks for t in b for u, w in zip([words, *t], [*t, words]))
    by_part, made = {}, []
    for k, texts in enumerate(blocks):
        pairs = word_pairs.BlockPairs(np.concatenate(texts), np.array([len(t) for t in texts]), numbers, counts, parts, hot)
        made.append(pairs)
        for part, data in pairs.sent(np.ones(len(pairs.step)), numbers, counts, np.full(words + 1, -1.5)):
            by_part.setdefault(part, []).append((k, data))
    kept, given, contexts, shared = {}, {}, Counter(), Counter()
    for part, sent in by_part.items():
        replies, _, tables, names, sums = word_pairs._part(sent)
        assert (tables >= 1).all()
        shared.update(dict(zip(names.tolist(), sums.tolist())))
        for k, (left, gave) in replies:
            at, run = made[k].part == part, made[k].run[made[k].part[made[k].run] == part]
            for u, w, x in zip(made[k].u[at], made[k].w[at], unpack(left, "<f4")):
                assert kept.setdefault((u, w), x) == x
            for u, x in zip(made[k].u[run], unpack(gave, "<f8")):
                assert given.setdefault((u, part), x) == x
    assert kept.keys() == plain.keys() and all(0 <= x < plain[p] for p, x in kept.items())
    for (u, _), x in given.items():
        contexts[u] += x
    for u in contexts:
        customers = sum(n for (a, _), n in plain.items() if a == u)
        assert contexts[u] + sum(x for (a, _), x in kept.items() if a == u) == pytest.approx(customers, rel=1e-5)
        assert (int(numbers[u]) in shared) == (counts[u] >= hot)
        if counts[u] >= hot:
            assert shared[int(numbers[u])] == pytest.approx(contexts[u])


def test_seating_against_a_plain_restaurant():
    """Mean tables of one dish, customers drawn one by one."""
    rng = np.random.default_rng(4)
    customers, base, discount = 40, 0.6, 0.4
    drawn = pitman_yor.seat(np.full(4000, customers), np.full(4000, base), discount, rng.integers(0, 2**63, 4000).astype(np.uint64))
    plain = []
    for _ in range(4000):
        tables = 1
        for seated in range(1, customers):
            tables += rng.random() < base / (base + seated - discount * tables)
        plain.append(tables)
    assert drawn.mean() == pytest.approx(np.mean(plain), rel=0.04)


def test_seating_is_bounded_and_grows():
    counts = np.array([0, 1, 2, 10, 1000, 100_000])
    t = pitman_yor.seat(counts, np.full(6, 0.5), 0.5, np.arange(6).astype(np.uint64))
    assert (t <= counts).all() and t[0] == 0 and t[1] == 1 and t[4] < t[5]


def test_common_subsequence():
    def brute(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = ([bytes([x]) for x in rng.integers(97, 103, int(rng.integers(1, 70)))] for _ in range(2))
        assert decontam.common_subsequence(a, b) == brute(a, b)


@pytest.fixture(scope="module")
def planted(spark):
    """Texts of random words with benchmark items: whole, with a word in eight replaced, and with marks and case changed."""
    rng = np.random.default_rng(8)
    vocabulary = np.array([f"w{int(x)}" for x in rng.integers(0, 10**6, 4000)])
    common = ["the", "of", "and", "to", "in"]
    speak = lambda n: [str(rng.choice(common)) if rng.random() < 0.3 else str(rng.choice(vocabulary)) for _ in range(n)]
    items = [speak(int(rng.integers(20, 60))) for _ in range(40)]
    docs, truth = [], {}
    for i in range(240):
        body, at = speak(int(rng.integers(30, 500))), int(rng.integers(0, 20))
        if i % 3 == 0:
            item = items[i // 3 % 40][:]
            if i % 2:
                item = [str(rng.choice(vocabulary)) if j % 8 == 3 else w for j, w in enumerate(item)]
            else:
                item = [w.upper() + "," for w in item]
            body[at:at] = item
            truth[i] = i // 3 % 40
        docs.append((i, " ".join(body)))
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(None, None), (99, "")]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"), truth


@pytest.mark.parametrize("items", [256, 16])
def test_decontamination_recall(planted, items):
    docs, bench, truth = planted
    out = {r["doc_id"]: r["item_ids"] for r in decontam.decontaminate(docs, bench, items=items).collect()}
    assert len(out) == docs.count()
    assert np.mean([truth[i] in out[i] for i in truth]) >= 0.9
    assert all(not v for i, v in out.items() if i not in truth)
    kept = decontam.keep_clean(docs, bench, items=items)
    assert kept.columns == docs.columns and kept.count() == sum(not v for v in out.values())


def test_decontamination_recall_of_a_full_block(spark):
    """A block of 256 items, half of them under 25 words, one paraphrase of each (every 8th word replaced) planted; brute force finds them all."""
    rng = np.random.default_rng(12)
    texts = [r["text"].split() for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").orderBy("doc_id").select("text").collect()]
    texts = [t for t in texts if len(t) >= 60]
    items, vocabulary = [], np.array(sorted({w for t in texts for w in t}))
    for i in range(256):
        t, n = texts[i * 3 % len(texts)], int(rng.integers(12, 25) if i % 2 else rng.integers(25, 61))
        at = int(rng.integers(0, len(t) - n + 1))
        items.append(t[at : at + n])
    docs = [[str(w) for w in rng.permutation(texts[int(rng.integers(0, len(texts)))])[:200]] for _ in items]
    for body, item in zip(docs, items):
        at = int(rng.integers(0, len(body)))
        body[at:at] = [str(rng.choice(vocabulary)) if j % 8 == 3 else w for j, w in enumerate(item)]

    def holds(body, item):
        own, words = decontam.normal_words(" ".join(item)), decontam.normal_words(" ".join(body))
        return max(decontam.common_subsequence(own, words[a : a + 2 * len(own)]) for a in range(0, len(words), max(1, len(own) // 4))) >= decontam.ALONE * len(own)

    want = {(i, i) for i, (body, item) in enumerate(zip(docs, items)) if holds(body, item)}
    rows = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(docs)] + [(1000 + i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    got = {(r["id"], r["item_id"]) for r in decontam.contaminated_pairs(rows, bench).collect()}
    short = {(i, i) for i, w in enumerate(items) if len(w) < 25} & want
    print('RECALL', len(want), len(short), len(want & got) / len(want), len(short & got) / len(short))
    assert len(want) > 240 and len(want & got) / len(want) >= 0.94


def test_decontamination_of_many_items_in_one_scan(spark):
    """2,000 items, one paraphrase of each (every 8th word replaced), one scan; brute force over every window finds what it finds."""
    rng = np.random.default_rng(13)
    vocabulary = [f"w{i}" for i in range(6000)]
    weights = 1 / np.arange(1, 6001)
    speak = lambda n: [vocabulary[i] for i in rng.choice(6000, n, p=weights / weights.sum())]
    items = [speak(int(rng.integers(15, 60))) for _ in range(2000)]
    docs = []
    for item in items:
        body = speak(80)
        body[20:20] = [vocabulary[int(rng.integers(6000))] if j % 8 == 3 else w for j, w in enumerate(item)]
        docs.append(body)
    long = speak(1000) + [w for item in items[:5] for w in item + speak(50)]
    rows = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(docs)] + [(9000, " ".join(long))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(f"item-{i}", " ".join(w)) for i, w in enumerate(items)], "item_id string, text string")
    scans, search = [], decontam._search
    try:
        decontam._search = lambda queries: scans.append(1) or search(queries)
        got = {(r["id"], r["item_id"]) for r in decontam.contaminated_pairs(rows, bench).collect()}
    finally:
        decontam._search = search
    want = set()
    for i, (body, item) in enumerate(zip(docs, items)):
        own, words = [w.encode() for w in item], [w.encode() for w in body]
        if max(decontam.common_subsequence(own, words[a : a + 2 * len(own)]) for a in range(0, len(words), 4)) >= decontam.ALONE * len(own):
            want.add((i, f"item-{i}"))
    assert len(scans) == 1 and len(want) > 1500
    assert len(want & got) / len(want) >= 0.95 and {(9000, f"item-{i}") for i in range(5)} <= got


def test_decontamination_of_long_texts_and_null_ids(spark, monkeypatch):
    """Long texts are searched in parts; an item without an id counts, as null; ids are of any type."""
    monkeypatch.setattr(decontam, "RUN_BYTES", 3000)
    rng = np.random.default_rng(14)
    item = [f"i{int(x)}" for x in rng.integers(0, 1000, 30)]
    body = [f"w{int(x)}" for x in rng.integers(0, 5000, 4000)]
    rows = [(f"d{k}", " ".join(body[:at] + item + body[at:])) for k, at in enumerate(range(0, 4000, 97))] + [("clean", " ".join(body)), ("one", "x" * 9000)]
    bench = spark.createDataFrame([(None, " ".join(item)), ("z", "words that nothing holds at all")], "item_id string, text string")
    out = {r["doc_id"]: r for r in decontam.decontaminate(spark.createDataFrame(rows, "doc_id string, text string"), bench).collect()}
    assert all(out[d]["contaminated"] == d.startswith("d") for d in out) and out["d0"]["item_ids"] == [None] and out["clean"]["item_ids"] == []


def test_decontamination_odd_rows(odd, spark):
    bench = spark.createDataFrame([(1, "same text here"), (2, None)], "item_id bigint, text string")
    out = decontam.decontaminate(odd, bench)
    assert out.count() == odd.count() and out.filter("contaminated").count() == 4
    assert decontam.keep_clean(odd, bench).columns == odd.columns
    assert decontam.decontaminate(odd, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.decontaminate(odd.limit(0), bench).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    held, bench = docs, [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            before, after = held.count(), out.count()
            if name == "near_duplicates":
                assert after == simhash.near_duplicates(held).select("component_id").distinct().count()
            if name == "benchmark_passages":
                leaked = [r["doc_id"] for r in held.collect() if any(b in r["text"] for b in bench)]
                assert not {r["doc_id"] for r in out.collect()} & set(leaked) and after == before - len(leaked)
            if name == "language":
                assert after >= 0.97 * before
            out.write.parquet(f"file://{tmp_path}/{name}")
            held = spark.read.parquet(f"file://{tmp_path}/{name}")
        else:
            assert out.count() == held.count()
    assert corpus_pipeline.run(spark, SF).count() == held.count()


def test_pipeline_stages_on_odd_rows(spark, odd):
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            assert out.count() <= 3 * max(1, rows.count())
