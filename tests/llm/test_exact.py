"""Operators with one right answer, against brute force, SQL and exact round trips."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from assay.llm import chat, linededup, mixing, oracles, quality, queries, simhash, tokens, wavelet

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path(tokens.BYTE_BPE))


# ---- SQL ----


@pytest.mark.parametrize("name", ["op1_line_dedup", "op6_source_mix", "op10_perspectives"])
def test_against_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())


# ---- SimHash ----


def brute_fingerprint(text):
    w = WORD.findall(lower(text or ""))
    parts = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_masks_cover_the_radius():
    rng = np.random.default_rng(0)
    for family in (simhash.FIRST, simhash.SECOND):
        assert len(family) == 15
        for _ in range(3000):
            bits = rng.choice(64, 3, replace=False)
            flip = sum(1 << int(b) for b in bits)
            assert any(m & flip == 0 for m in family)
    assert simhash.OPEN_BITS <= 24


@pytest.mark.parametrize("run", [simhash.RUN, 2])
def test_simhash_links_all_pairs_within_the_radius(spark, run):
    """Random fingerprints around few centres; with runs of two, nearly every bucket takes the second family."""
    rng = np.random.default_rng(1)
    centres = [int(x) for x in rng.integers(0, 2**63, 6)]
    prints = []
    for c in centres:
        for _ in range(25):
            x = c
            for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                x ^= 1 << int(b)
            prints.append(x)
    prints = sorted(set(prints))
    roots = brute_components(prints)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp bigint")
    edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, run).collect()]
    at = {p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert (a ^ b).bit_count() <= 3
        parent[find(at[a])] = find(at[b])
    got = [find(i) for i in range(len(prints))]
    same = lambda r: {frozenset(i for i in range(len(r)) if r[i] == x) for x in set(r)}
    assert same(got) == same(roots)


def test_simhash_query(docs, spark):
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    roots = brute_components(prints)
    least = {}
    for r, root in zip(rows, roots):
        least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    want = {r["doc_id"]: (f"{p:016x}", least[root]) for r, p, root in zip(rows, prints, roots)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()} == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_simhash_odd_rows(odd):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    zero = [r for r in out if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {1}
    same = [r for r in out if r["fingerprint"] == f"{brute_fingerprint('same text here'):016x}"]
    assert len(same) == 4 and {r["component_id"] for r in same} == {4}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [1, 4, 6, 7, 8, 9]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_keep_one_of_each_group(spark):
    """Different texts without ids, and two texts under one id, are groups of their own; repeats and near copies go."""
    rows = [(None, "first text without an id"), (None, "first text without an id"), (None, "quite another one, also without"), (1, "one text under this id"), (1, "one text under this id"), (1, "a different text under the same id"), (2, "one text under this id"), (None, "one text under this id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted([rows[0], rows[2], rows[3], rows[5]], key=repr)
    for stage in (lambda d: simhash.keep_one(d, one_an_id=False), lambda d: corpus_pipeline.near_duplicates(spark, d, SF)):
        assert sorted((tuple(r) for r in stage(docs).collect()), key=repr) == want
    cut = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert len(cut) == 3 and {rows[0], rows[2]} <= set(cut)


# ---- tokens ----


def test_token_counts_and_cache(spark, docs, tmp_path):
    tk, path = whole_tokenizer(), f"file://{tmp_path}/cache"
    want = {r["doc_id"]: (len(r["text"].encode()), len(tk.encode(r["text"], add_special_tokens=False).ids)) for r in docs.collect()}
    out = tokens.token_counts(docs, path).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in out} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in out)
    first = spark.read.parquet(path).count()
    assert first == docs.select("text").distinct().count()
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, "new text")], "doc_id bigint, text string"))
    assert tokens.token_counts(more, path).count() == docs.count() + 1
    assert spark.read.parquet(path).count() == first + 1


def test_tokens_odd_rows(odd):
    tk = whole_tokenizer()
    out = tokens.token_counts(odd).collect()
    want = sorted((r["doc_id"] or 0, len(tk.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in out) == want
    assert tokens.token_counts(odd.limit(0)).count() == 0


def test_pieces_equal_the_library():
    rng, tk, own = np.random.default_rng(3), whole_tokenizer(), tokens.encoder(tokens.BYTE_BPE)
    parts = [" ", "  ", "\n", "a", "the", "don't", "'s", " 's", "é", "<|endoftext|>", "<|", "|>", "123", "#", "\t", " ", "日本", "!?", "\r\n", "x1", "\x1c", "\x85", "_", "ß", "'"]
    for _ in range(4000):
        t = "".join(rng.choice(parts, int(rng.integers(0, 14))))
        assert np.frombuffer(own.encode(t), "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)
    small = tokens.PieceEncoder(tokens.vocabulary_path(tokens.BYTE_BPE), remembered=3)
    assert small.encode("one two three four five six one two") == own.encode("one two three four five six one two")


def test_wavelet_matrix_round_trip():
    rng = np.random.default_rng(4)
    for ids in (rng.integers(0, 50257, 3000), rng.integers(0, 5, 1500), np.zeros(10, int), np.array([], int), np.array([50256])):
        ids = ids.astype(np.uint32)
        packed = wavelet.WaveletMatrix.build(ids).pack()
        m = wavelet.WaveletMatrix.unpack(packed["n"], packed["zeros"], packed["ranks"], packed["planes"])
        assert m.decode().tolist() == ids.tolist()
        for i in rng.integers(0, len(ids), 20) if len(ids) else ():
            assert m.access(int(i)) == ids[i]
            assert m.rank(int(ids[i]), int(i)) == int((ids[:i] == ids[i]).sum())
            assert m.occurrences(int(ids[i])) == np.flatnonzero(ids == ids[i]).tolist()
        assert m.count(60000) == 0


def shard_rows(rows):
    tk, start, out = whole_tokenizer(), 0, []
    for doc_id, text in rows:
        ids = tk.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_shards(spark, docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    wavelet.write_shards(docs, path, shards=3, segment=20_000)
    got = sorted(tuple(r) for r in wavelet.read_documents(spark, path).collect())
    assert got == sorted(shard_rows(sorted((r["doc_id"], r["text"]) for r in docs.collect())))
    tk = whole_tokenizer()
    ids = {r["doc_id"]: tk.encode(r["text"], add_special_tokens=False).ids + [0] for r in docs.collect()}
    want = sorted((d, i) for d, own in ids.items() for i, x in enumerate(own) if x == 262)
    assert sorted(tuple(r) for r in wavelet.find_token(spark, path, 262).collect()) == want
    every = [x for d in sorted(ids) for x in ids[d]]
    assert [wavelet.count_token(spark, path, x) for x in (262, 0, 50_000_000)] == [every.count(262), every.count(0), 0]
    places = [0, 5, 20_000, len(every) - 1, len(every)]
    assert sorted(tuple(r) for r in wavelet.tokens_at(spark, path, places).collect()) == [(i, every[i]) for i in places[:-1]]


def test_shards_of_string_ids(spark, tmp_path):
    rows = [("b", "two words"), ("a", "x"), (None, "no id"), ("c", None)]
    path = f"file://{tmp_path}/shards"
    got = wavelet.token_shards(spark.createDataFrame(rows, "doc_id string, text string"), path).orderBy("start").collect()
    assert [tuple(r) for r in got] == shard_rows([rows[2], rows[1], rows[0], rows[3]])
    assert wavelet.find_token(spark, path, 0).count() == 4


def test_long_texts_are_encoded_whole(spark, monkeypatch):
    """A text beyond one run is cut at spaces; one without spaces stays whole."""
    monkeypatch.setattr(tokens, "RUN_BYTES", 1000)
    tk, own = whole_tokenizer(), tokens.encoder(tokens.BYTE_BPE)
    for text in ("some words, and more of them. " * 200, "x" * 5000, "日本語 " * 800, "don't  stop\n\n" * 300):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tk.encode(text, add_special_tokens=False).ids


def test_shards_odd_rows(odd):
    got = wavelet.token_shards(odd).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in odd.collect()), key=lambda x: (x is not None, x))
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((d or 0, n, c) for d, _, n, c in shard_rows([(r["doc_id"], r["text"]) for r in odd.collect()]))
    ends = 0
    for r in got:
        assert r["start"] == ends
        ends += r["n_tokens"]
    assert wavelet.token_shards(odd.limit(0)).count() == 0


# ---- line dedup ----


def test_chunks_resist_shifts(spark):
    lines = [f"line {i} of the passage" for i in range(30)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["an inserted line", "and one more", *lines])), (3, "nothing else")]
    out = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[1]["n_removed_lines"] == 0 and out[3]["text"] == "nothing else"
    assert out[2]["n_removed_lines"] >= 20 and out[2]["text"].startswith("an inserted line")


def test_shared_passages_are_found(spark):
    """Passages of over 50 words in 1 to 8 lines, each in two documents among lines of their own; short repeats of single lines stay."""
    rng = np.random.default_rng(6)
    line = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(0, 10**6, n))
    rows, planted = [], {}
    for k in range(80):
        n = k % 8 + 1
        passage = [line(60 // n + 1) for _ in range(n)]
        if k % 3 == 0 and n > 1:
            passage[1:1] = ["", ""]
        for copy in range(2):
            doc = [line(int(rng.integers(3, 12))) for _ in range(8)] + ["a common line"]
            at = int(rng.integers(0, 8))  # never beside the common line
            doc[at:at] = passage
            rows.append((2 * k + copy, "\n".join(doc)))
        planted[2 * k + 1] = (passage, [x for x in doc if x not in passage or not x])
    out = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, text in rows:
        if i % 2 == 0:
            assert out[i]["text"] == text and out[i]["n_removed_lines"] == 0
        else:
            passage, _ = planted[i]
            assert out[i]["n_removed_lines"] >= len([x for x in passage if x]) and not set(filter(None, passage)) & set(out[i]["text"].split("\n"))
            assert "a common line" in out[i]["text"]


def test_line_dedup_odd_rows(odd):
    out = linededup.dedup_lines(odd)
    assert out.count() == odd.count() and out.columns[: len(odd.columns)] == odd.columns
    rows = out.collect()
    assert all(r["text"] is None for r in rows if r["doc_id"] == 1)
    assert {r["text"] for r in rows if r["doc_id"] == 4} == {"same text here", "other text, same id"}
    assert linededup.dedup_lines(odd.limit(0)).count() == 0


# ---- quality ----


def brute_statistics(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics(odd, docs):
    for df in (odd, docs):
        got = quality.statistics(df).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert Counter(tuple(r) for r in got) == Counter(brute_statistics(r["text"]) for r in df.collect())


def test_rules_are_learned_and_applied(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(40 + i % 7)), 1) for i in range(120)]
    bad = [(1000 + i, " ".join(f"###{i}{j}" for j in range(40 + i % 5)), 0) for i in range(60)]
    rows = spark.createDataFrame(good + bad, "doc_id bigint, text string, quality int")
    out = quality.assess(rows.select("doc_id", "text"), rows.select("doc_id", "quality")).collect()
    assert all(r["kept"] == (r["doc_id"] < 1000) for r in out) and {r["rule"] for r in out if not r["kept"]} == {1}
    none = quality.assess(rows.select("doc_id", "text"), rows.select("doc_id", "quality").limit(0)).collect()
    assert all(r["kept"] and r["rule"] == 0 for r in none)


def test_quality_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (None, 1), (9, None)], "doc_id bigint, quality int")
    out = quality.assess(odd, labels)
    assert out.count() == odd.count() and out.filter("text_is_null is not null" if "text_is_null" in out.columns else "kept is null").count() == 0
    assert quality.assess(odd.limit(0), labels.limit(0)).count() == 0


# ---- mixing ----


def test_mix_reaches_targets(docs):
    rows = mixing.mix_report(docs).collect()
    total = sum(r["size"] for r in rows)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    by = {}
    for r in rows:
        by.setdefault(source[r["doc_id"]], []).append(r)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(total)
    for v in by.values():
        largest = max(r["size"] for r in v)
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= largest
        assert all(r["taken"] <= 3 * r["size"] for r in v) and v[0]["target"] <= 3 * v[0]["source_size"] + 1e-6
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert all(taken.get(r["doc_id"], 0) * r["size"] == r["taken"] for r in rows)


def test_mix_clamps(spark):
    docs = spark.createDataFrame([(1, "a b", "a"), *[(i, "x " * 10, "b") for i in range(2, 12)]], "doc_id bigint, text string, source string")
    rows = {r["doc_id"]: r for r in mixing.mix_report(docs).collect()}
    assert rows[1]["target"] == 6 and rows[1]["taken"] == 6 and rows[2]["target"] == 96


def test_mix_reaches_targets_without_ids(spark):
    """Rows without ids, rows that share one, and rows that are wholly alike."""
    rows = [(None, f"text {i} of ten words or so in all here", "a") for i in range(50)] + [(None, "the same ten words in every row of this one", "b")] * 50 + [(7, f"w{i} " * 10, "c") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    report = mixing.mix_report(docs).collect()
    mixed = Counter((r["doc_id"], r["text"]) for r in mixing.mix(docs).collect())
    for size, target in {(r["source_size"], r["target"]) for r in report}:
        own = [r for r in report if (r["source_size"], r["target"]) == (size, target)]
        assert abs(sum(r["taken"] for r in own) - target) <= 5 and {r["taken"] // r["size"] for r in own} <= {0, 1, 2, 3}
    assert sum(len(t.split()) * n for (_, t), n in mixed.items()) == sum(r["taken"] for r in report)


def test_mix_odd_rows(odd):
    rows = mixing.mix_report(odd).collect()
    assert len(rows) == odd.count() and mixing.mix(odd).columns == odd.columns
    assert mixing.mix_report(odd.limit(0)).count() == 0 and mixing.mix(odd.limit(0)).count() == 0


# ---- chat ----


def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 300, "ann", None), (2, 0, "system", "alone"), (None, 5, None, "who"), (None, None, "ann", "first"), (1, 1, "ann", "hi")]
    df = spark.createDataFrame([(*t, 7) for t in turns], "conv_id bigint, turn bigint, role string, text string, start int")
    out = {(r["conv_id"], r["perspective"]): r for r in chat.render(df).collect()}
    assert set(out) == {(1, "ann"), (1, "bob"), (None, "unknown"), (None, "ann")}
    ann = out[(1, "ann")]["rendered"]
    assert ann == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\nyo<|end|>\n<|assistant|>\n<|end|>\n"
    assert [ann[m["start"] : m["end"]] for m in out[(1, "ann")]["masks"]] == ["hi<|end|>\n", "hi<|end|>\n", "<|end|>\n"]
    assert out[(None, "ann")]["rendered"].startswith("<|assistant|>\nfirst")
    assert chat.rotate(df.limit(0)).count() == 0
    assert chat.rotate(df, block=1).exceptAll(chat.rotate(df)).count() == 0
