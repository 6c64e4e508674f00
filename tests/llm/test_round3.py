"""Hard negatives, the filter audit and packing, against SQL, brute force and exact round trips."""

import random
import zlib
from collections import Counter, defaultdict, deque
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import audit, langid, linededup, mixing, negatives, packing, quality, queries, simhash, tokens

from .conftest import LONG, SF


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_filter_audit"])
def test_against_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    rows = rows_of(df, names)
    assert rows and rows == sorted(found.fetchall(), key=repr)


# ---- hard negatives ----


def brute_negatives(rows, positives=5, k=10, low=30, high=90):
    """Scores as Python integers, for rows (id, label, vector) that take part."""
    rows = list(dict.fromkeys((i, label, tuple(int(np.floor(256 * float(x))) for x in v)) for i, label, v in rows))
    key = lambda s, r: (-s, r[0] is None, r[0] or 0)
    out = []
    for a in rows:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(((sum(x * y for x, y in zip(a[2], b[2])), b) for b in rows if b != a), key=lambda x: key(*x))
        for p, b in [x for x in scored if x[1][1] == a[1]][:positives]:
            near = [x for x in scored if x[1][1] != a[1] and low * p <= 100 * x[0] <= high * p][:k]
            out += [(a[0], b[0], i + 1, n[0], p, s) for i, (s, n) in enumerate(near)]
    return sorted(out, key=repr)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives_of_odd_rows(spark):
    rng = random.Random(3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), [rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(0, 600, 20)]  # many ties
    rows += [(700, 1, [0.5, 1.0]), (700, 1, [1.0, 1.0]), (700, 2, [1.0, 1.0, 0.5, 0.25, 1.0]), (None, 1, [1.0, 0.5]), (None, 2, [0.5, 0.5]), (800, 9, [1.0]), (900, 1, [])]
    odd = [(100, None, [1.0]), (200, 1, None), (300, 1, [nan]), (400, 2, [inf, 1.0]), (500, 1, [None, 1.0]), (None, None, None)]
    df = spark.createDataFrame([*rows, *rows[:9], *odd], "vec_id bigint, label int, embedding array<double>")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("id", "v", "a", "r", "rid", "rank", "anchor")])
    got = rows_of(negatives.mine(df, F.col("vec_id") % 100 == 0), COLUMNS)
    assert len(got) > 100 and got == brute_negatives(rows)


def test_negatives_in_small_blocks_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 7)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 2)
    rng = np.random.default_rng(5)
    rows = [(int(i), int(i) % 3, [float(x) for x in rng.integers(-(2**22), 2**22, 3)]) for i in rng.permutation(130) * 25]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    got = rows_of(negatives.mine(df, F.col("vec_id") % 100 == 0, positives=3, k=4, low=10, high=100), COLUMNS)
    assert got == brute_negatives(rows, 3, 4, 10, 100) and max(abs(r[5]) for r in got) > 2**53
    assert negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert negatives.mine(df, F.col("vec_id") == -1).collect() == []


def test_negatives_of_string_ids_and_labels(spark):
    rng = random.Random(4)
    rows = [(f"id-{i:03}", rng.choice("xyz"), [rng.random() for _ in range(8)]) for i in range(60)]
    got = negatives.mine(spark.createDataFrame(rows, "key string, kind string, vector array<float>"), F.col("key") == "id-007", "key", "vector", "kind").collect()
    kinds = {i: kind for i, kind, _ in rows}
    assert got and all(kinds[r["positive_id"]] == kinds["id-007"] != kinds[r["negative_id"]] and r["positive_id"] != "id-007" for r in got)


# ---- filter audit ----


def brute_audit(docs, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    cases = []
    for d, text, part in docs:
        t = text or ""
        w = t.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
        w = [x for x in w if x]
        flags = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), d is not None and d > first[t])
        cases.append((part or "", d in good, d in toxic, flags))
    out, total = {}, Counter()
    for order in permutations(range(5)):
        for part in {c[0] for c in cases}:
            left = [c for c in cases if c[0] == part]
            for step, f in enumerate(order, 1):
                gone = [c for c in left if c[3][f]]
                fails = [c for c in cases if c[0] == part and c[3][f]]
                left = [c for c in left if not c[3][f]]
                total[part, f] += len(gone)
                out[part, "".join("ABCDE"[i] for i in order), step] = (f, len(left), len(gone), len(fails) - len(gone), sum(sum(c[3]) == 1 for c in fails), sum(c[1] for c in gone), sum(c[2] for c in gone))
    return sorted((*k, *v[1:], total[k[0], v[0]]) for k, v in out.items())


def test_audit_of_odd_rows(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n ", "LOUD words", "a # b", "a" * 30, LONG, LONG + "&", "ZÉRO Ünïcode 日本語", "\x0b\x0c x", " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250))]
    docs = [(rng.choice([None, 1, 1, *range(2, 40)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(150)]
    labels = [(rng.choice([None, *range(1, 30)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["id", "part", "mask", "n", "digest", "first", "good", "toxic", "step"])])
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit(7))
    out = audit.audit(df, marks)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert out.columns == columns
    assert sorted(tuple(r) for r in out.collect()) == brute_audit(docs, labels)
    assert audit.audit(df.limit(0), marks).collect() == []
    named = audit.audit(df.withColumn("doc_id", F.concat(F.lit("id-"), F.lpad("doc_id", 3, "0"))), marks.withColumn("doc_id", F.concat(F.lit("id-"), F.lpad("doc_id", 3, "0"))))
    assert sorted(tuple(r) for r in named.collect()) == brute_audit(docs, labels)


def test_interactions_of_three_filters(spark):
    cases = spark.createDataFrame([("p", 0, 5, 1), ("p", 1, 4, 0), ("p", 3, 2, 2), ("p", 6, 1, 0), ("q", 7, 3, 3)], "part string, mask int, n bigint, kind bigint")
    rows = {(r["part"], r["filter_order"], r["step"]): r for r in audit.interactions(cases, "xyz", ("kind",)).collect()}
    assert len(rows) == 2 * 6 * 3
    assert (rows["p", "yxz", 1]["removed"], rows["p", "yxz", 1]["kind_lost"], rows["p", "yxz", 2]["removed"], rows["p", "yxz", 3]["kept"]) == (3, 2, 4, 5)
    assert sum(rows["p", "xyz", s]["shapley"] for s in (1, 2, 3)) == 6 * 7  # all that is removed, in each of six orders
    assert {rows["q", "zyx", s]["shapley"] for s in (1, 2, 3)} == {6}
    with pytest.raises(ValueError):
        audit.interactions(cases, "aa")


# ---- packing ----


def played(cells, quanta, cell):
    """Deficit round-robin, played round by round: (queue, cell) in order of service."""
    queues, deficit, out = [deque(range(n)) for n in cells], [cell * packing.UNIT // 2] * len(cells), []
    while any(queues):
        for q, queue in enumerate(queues):
            if queue:
                deficit[q] += quanta[q]
                while queue and deficit[q] >= cell * packing.UNIT:
                    deficit[q] -= cell * packing.UNIT
                    out.append((q, queue.popleft()))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_service_is_deficit_round_robin(seed):
    rng = random.Random(seed)
    held = [rng.choice([0, 1, 63, 64, 65, 700, 5000, 40_000]) for _ in range(rng.randrange(1, 9))]
    weights = [float(x) for x in held] if seed % 2 else [rng.choice([1.0, 2.0, 7.0]) for _ in held]
    service = packing.Service(held, weights)
    order = played([n // 64 for n in held], service.quantum.tolist(), 64)
    want = {c: i for i, c in enumerate(order)}
    q, j = (np.array(x, np.int64) for x in zip(*sorted(want))) if want else (np.empty(0, np.int64),) * 2
    assert service.places(q, j).tolist() == [want[c] for c in zip(q.tolist(), j.tolist())]
    # all tokens, in one document for each queue and in many: each place once, the same either way
    taken = []
    for cuts in (lambda n: [(0, n)], lambda n: [(a, min(n, a + 37)) for a in range(0, n, 37)]):
        docs = [(i, a, b) for i, n in enumerate(held) for a, b in cuts(n) if b > a]
        queue, a, b = (np.array(x, np.int64) for x in zip(*docs)) if docs else (np.empty(0, np.int64),) * 3
        row, begin, length, sequence, offset = service.pieces(queue, a, b - a)
        places = {}
        for r, s, n, w, o in zip(row.tolist(), begin.tolist(), length.tolist(), sequence.tolist(), offset.tolist()):
            for k in range(n):
                assert (w, o + k) not in places
                places[w, o + k] = (docs[r][0], docs[r][1] + s + k)
        assert len(places) == sum(held) == len(set(places.values()))
        taken.append(places)
    assert taken[0] == taken[1]
    sizes = Counter(w for w, _ in taken[0])
    assert set(sizes) == set(range(len(sizes))) and all(n == 2048 or n & (n - 1) == 0 for n in sizes.values())


def checked(rows, texts):
    """Pieces by sequence, after each document's ids are found whole and each sequence without a gap."""
    library = tokens.encoder(tokens.BYTE_BPE).whole
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for d, text in texts.items():
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    assert set(sequences) == set(range(len(sequences)))
    return sequences


def test_packing_keeps_shares(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5, "doc_id")
    rows = packing.pack(docs).collect()
    sequences = checked(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    held = Counter()
    for r in rows:
        held[source[r["doc_id"]]] += r["length"]
    full = [s for s in sequences.values() if sum(r["length"] for r in s) == 2048]
    assert len(full) > 20
    so_far, shares = Counter(), {k: 2048 * n / sum(held.values()) for k, n in held.items()}
    for i, w in enumerate(sorted(w for w, s in sequences.items() if s in full)[:-1], 1):
        own = Counter()
        for r in sequences[w]:
            own[source[r["doc_id"]]] += r["length"]
        so_far += own
        assert all(abs(own[k] - x) <= (2 + len(held) / 4) * packing.CELL for k, x in shares.items())
        assert all(abs(so_far[k] - i * x) <= (1 + len(held) / 2) * packing.CELL for k, x in shares.items())  # what is owed is carried


def test_packing_by_weights(spark):
    docs = spark.createDataFrame([(i, "one two three four " * 20, None if i % 3 else "b") for i in range(400)], "doc_id bigint, text string, source string").coalesce(1)
    sequences = checked(packing.pack(docs, {None: 1.0, "b": 3.0}, window=256).withColumn("sequence_id", F.col("sequence_id")).collect(), {i: "one two three four " * 20 for i in range(400)})
    own = lambda s: sum(r["length"] for r in s if r["doc_id"] % 3 == 0)
    assert [own(sequences[i]) for i in range(8)] == [192] * 8 and own(sequences[max(sequences) - 12]) == 0
    with pytest.raises(ValueError):
        packing.pack(docs, window=100)


def test_packing_of_odd_rows(spark, odd, monkeypatch):
    own = odd.filter("doc_id IS NOT NULL AND doc_id <> 4")
    checked(packing.pack(own).collect(), {r["doc_id"]: r["text"] for r in own.collect()})
    monkeypatch.setattr(packing, "QUEUES", 1)  # all other sources share a queue
    checked(packing.pack(own.repartition(3)).collect(), {r["doc_id"]: r["text"] for r in own.collect()})
    every = packing.pack(odd)
    assert every.agg(F.sum("length")).first()[0] == sum(len(tokens.encoder(tokens.BYTE_BPE).encode(r["text"] or "")) // 4 + 1 for r in odd.collect())
    assert packing.pack(odd.withColumn("doc_id", F.concat(F.lit("a-"), "doc_id"))).filter("doc_id = 'a-4' AND start = 0").count() == 3
    assert packing.pack(odd.limit(0)).collect() == []


# ---- ids of other types, and the bound of a sample ----


def test_string_ids_give_what_numbers_give(odd, spark):
    """Ids ``a-1`` and so on stand in the order of their numbers."""
    named = odd.withColumn("doc_id", F.concat(F.lit("a-"), F.col("doc_id").cast("string")))
    plain = lambda v: None if v is None else int(str(v).removeprefix("a-"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)], "doc_id bigint, quality int, toxic int")
    operators = {
        "dedup": (linededup.dedup_lines, ["text", "n_chunks_", "n_removed_chunks", "n_removed_lines"]),
        "near": (simhash.near_duplicates, ["fingerprint", "component_id"]),
        "kept": (simhash.keep_one, ["text"]),
        "counts": (tokens.token_counts, ["n_bytes", "n_tokens"]),
        "mix": (mixing.mix_report, ["source_size", "target"]),
    }
    for name, (operator, columns) in operators.items():
        a, b = (sorted(((plain(r["doc_id"]), *(plain(r[c]) if c == "component_id" else r[c] for c in columns)) for r in operator(df).collect()), key=repr) for df in (odd, named))
        assert a == b and a, name
    assessed = quality.assess(named, labels.withColumn("doc_id", F.concat(F.lit("a-"), "doc_id"))).collect()
    assert len(assessed) == odd.count() == langid.identify(named).count()


def test_repeated_rows_are_drawn_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda rows: seen.append(rows) or "model")
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = spark.range(3000).selectExpr("if(id % 2 = 0, 1, id) as doc_id", "if(id % 2 = 0, 'the same text', concat('text ', id)) as text", "if(id % 2 = 0, 'l0', concat('l', pmod(id * 7, 40))) as lang")
    assert langid.fit(rows, sample_rows=5000) == "model"
    assert len({r[0] for r in seen[0]}) <= 3 and sum(r[1] == "the same text" for r in seen[0]) <= 1 and 0 < len(seen[0]) < 400


def test_language_samples_hold_whole_texts(spark, monkeypatch):
    """What reaches training are the counts of the whole text, long ones too, and of repeated rows once."""
    seen = []
    monkeypatch.setattr(langid, "train", lambda rows: seen.extend(rows) or "model")
    long = "anfang " + "mitte und weiter " * 20000 + "ende"
    rows = [(i, long if i == 1 else None if i == 2 else "123 ½" if i == 3 else "immer gleich", "de") for i in range(5)] + [(7, "immer gleich", "de")] * 30
    langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    found = sorted((lang, bytes(idx), bytes(n)) for lang, (idx, n) in seen)
    learned = [(i, t) for i, t in {(i, t) for i, t, _ in rows} if zlib.crc32(str(i).encode()) % 5 and t is not None and langid.has_letter(t)]
    assert found == sorted(("de", *langid.counts(t)) for _, t in learned) and any(t == long for _, t in learned)


def test_hot_lines_copy_no_other_chunk(spark, monkeypatch):
    """A pair of lines in every document is dealt into parts; other repeated chunks stay whole, and the result is that without parts."""
    rows = [(i, f"of {i} alone\nhot one\nhot two\nof {i} too\n" + f"pair {i // 2} " * 30 + "\n" + f"next {i // 2} " * 30) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = sorted(linededup.dedup_lines(docs).collect())
    copies, explode = [], linededup._meet
    monkeypatch.setattr(linededup, "PART_ROWS", 5)
    monkeypatch.setattr(linededup, "partitions", lambda spark: 1000)

    def watched(rows, groups, on):
        out = explode(rows, groups, on)
        copies.append((groups.filter("n > 5").count(), out.select(*on, "part", "parts").distinct().groupBy(*on).count().filter("count > 1").count()))
        return out

    monkeypatch.setattr(linededup, "_meet", watched)
    assert sorted(linededup.dedup_lines(docs).collect()) == whole
    assert all(dealt <= hot for hot, dealt in copies) and copies[1] == (1, 1)
    assert sum(r["n_removed_lines"] for r in whole) > 200


@pytest.mark.parametrize("number", [lambda line: F.length(line).cast("bigint") % 5, lambda line: F.lit(0).cast("bigint") + 0 * F.length(line)])
def test_lines_of_one_number_are_told_apart(spark, docs, odd, monkeypatch, number):
    """Lines whose numbers are forced to be equal are compared as bytes: the result is that of true hashes."""
    a, b, c = "first " * 60, "other " * 60, "short one"
    rows = [(1, f"{a}\n{c}\n{b}"), (2, f"{b}\n{c}"), (3, f"{a}\n\n{c}\n{b}"), (4, f"{c}\n{c}\n{c}"), (5, "unlike " * 60), (6, f"{a}\n{b}\n{a}")]
    small = spark.createDataFrame(rows, "doc_id bigint, text string")
    frames = [small, odd, docs.select("doc_id", "text")]
    true = [sorted(linededup.dedup_lines(f).collect(), key=repr) for f in frames]
    by_id = {r["doc_id"]: r for r in true[0]}
    assert by_id[1]["text"] == rows[0][1] and by_id[5]["text"] == rows[4][1] and by_id[3]["n_removed_lines"] >= 3
    monkeypatch.setattr(linededup, "line_number", number)
    assert [sorted(linededup.dedup_lines(f).collect(), key=repr) for f in frames] == true
