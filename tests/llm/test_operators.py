"""Each operator against brute force on small tables, and on rows that are null, empty, long, tied, repeated or absent."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sigloom.llm.registry")

import corpus_pipeline  # noqa: E402
from sigloom.llm import chat, components, decontamination, eliasfano, fingerprints, html, mixing, ngramjoin, ordered, sharding, suffixes, tokenids, toxicity, words  # noqa: E402

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, position double, _h string, _id int, keep string, size int, _text_hash int"
LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows; extra columns with names the operators use."""
    texts = [(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, LONG), (5, "alpha beta gamma delta epsilon zeta"), (5, "alpha beta gamma delta epsilon zeta"), (None, "no id here at all, really none"), (7, "%%% $$$"), (8, LONG + " tail"), (9, "one")]
    rows = [(i, t, None if i == 3 else "en", None if i == 9 else "src0", None, 1.5, "x", 3, "k", 4, 5) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def text_of(docs):
    return docs.select("doc_id", "text").collect()


# 1


def test_toxicity_learns_what_labels_mark(spark, small):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.train(small, labels)
    found = {r.doc_id: r for r in toxicity.score(small, model).collect()}
    assert len(found) == small.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    known = [(r.toxic, found[r.doc_id].score) for r in labels.collect() if r.doc_id in found]
    toxic, civil = [s for t, s in known if t], [s for t, s in known if not t]
    assert np.mean(toxic) > np.mean(civil)


def test_toxicity_model_survives_shipping():
    tables = {n: np.zeros(toxicity.SLOTS, np.float32) for n in ("top.t", "top.o", "context.nt", "context.no", "context.dt", "context.do", "shared.n", "shared_context.n", "shared_context.kinds")}
    tables["top.t"][[5, 99, toxicity.SLOTS - 1]] = [1, 2, 3]
    model = toxicity.Model(tables, 0.25)
    other = toxicity.Packed.of(model).open()
    assert all((other.tables[n] == t).all() for n, t in tables.items()) and other.scores(["any text", ""]).tolist() == [0.25, 0.25]


def test_letter_models_next_to_brute_force(spark):
    counts = {"abba": (3, 1), "abc": (0, 5), "cab": (2, 2), "b": (1, 0), "abbacus": (1, 1), "zebra": (0, 2), "é": (4, 0)}
    model = toxicity.Model(toxicity.tables(spark.createDataFrame([(w, *c) for w, c in counts.items()], "word string, toxic bigint, ordinary bigint")), 0.5)
    top = {}
    for word, c in counts.items():
        p = f"^{word}$"
        for i in range(2, len(p) + 1):
            gram = p[max(0, i - toxicity.ORDER) : i]
            top[gram] = [a + b for a, b in zip(top.get(gram, (0, 0)), c)]
    ends = {g[k:] for g in top for k in range(len(g))}

    def shared(g):
        if not g:
            return toxicity.FLOOR
        follow = {e[1:]: sum(x[1:] == e[1:] for x in ends if len(x) > 1) for e in ends if len(e) > 1 and e[1:-1] == g[:-1] and len(e) == len(g) + 1}
        below = shared(g[1:])
        if not follow:
            return below
        return (max(follow.get(g, 0) - 0.75, 0) + 0.75 * len(follow) * below) / sum(follow.values())

    def share(g, c):
        near = {h: top[h][c] for h in top if h[:-1] == g[:-1] and len(h) == len(g)}
        cuts = {h: (0, 1.0, 1.6, 2.2)[min(n, 3)] for h, n in near.items()}
        n, below = sum(near.values()), shared(g[1:])
        return (max(near.get(g, 0) - cuts.get(g, 0), 0) + max(sum(cuts.values()), 1e-3) * below) / n if n else below

    for gram in [*top, "^q", "abbax", "cabbac", "^abz", "xyz"]:
        assert model.gram(gram) == pytest.approx(np.log(share(gram, 0)) - np.log(share(gram, 1)), rel=1e-4, abs=1e-6), gram


def test_features_are_those_of_the_words():
    model = toxicity.Model({f"{t}.key": np.zeros(0, np.uint64) for t in ("top", "context", "shared", "shared_context")}, 0.5)
    model.word = lambda w: len(w) - 3.0
    texts = ["", "a bb CCC dddd eeeee", "%% $$", "naïve \u00e9t\u00e9 " * 20, "x"]
    for _ in range(2):
        got = model.features(texts)
        for text, row in zip(texts, got):
            each = np.array([len(w) - 3.0 for w in toxicity.WORD.findall(text.lower())])
            n = len(each)
            if not n:
                assert not row.any()
                continue
            w = min(n, toxicity.WINDOW)
            best = np.append(np.sort(np.maximum(each, 0))[::-1], np.zeros(8))[:8]
            want = [each.mean(), max(each[i : i + w].sum() for i in range(n - w + 1)) / toxicity.WINDOW, best[0], best[:3].mean(), best.mean(), np.log(n)]
            assert row == pytest.approx(want)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (None, 0, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(odd, toxicity.train(odd, labels)).count() == odd.count()
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert toxicity.score(odd, toxicity.train(odd, labels.limit(0))).filter("score <> 0 OR predicted <> 0").count() == 0


# 2


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 20_000])
def test_shards_are_even_and_gapless(small, bucket_bytes):
    got = sharding.shard_documents(small, bucket_bytes=bucket_bytes).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, r.text) for r in text_of(small))


def test_a_row_that_repeats_is_spread(spark, small):
    same = spark.createDataFrame([(1, "same text", "en", "src0", 9)], small.schema)
    docs = small.union(same.crossJoin(spark.range(5000)).drop("id"))
    runs = [sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(docs.repartition(n), bucket_bytes=20_000, copies=100).collect()) for n in (2, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == small.count() + 5000
    assert sorted((s, i) for _, s, i in runs[0]) == sorted(set((s, i) for _, s, i in runs[0]))
    per_shard = [sum(d == 1 and s == k for d, s, _ in runs[0]) for k in range(24)]
    assert min(per_shard) > 100


def test_shuffle_repeats_and_mixes(small):
    a = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(small).collect()}
    assert a == {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(small).collect()}
    assert a != {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(small, seed=5).collect()}
    order = np.array([a[i][0] for i in sorted(a)])
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.3


def test_shards_of_odd_rows(odd, none, tmp_path):
    sharded = sharding.shard_documents(odd)
    assert sharded.count() == odd.count() and sharded.columns == [*odd.columns, "shard", "slot"]
    rows = {(r.doc_id, r.size, r.text_crc32) for r in sharding.digest(sharded).collect()}
    assert (2, 8, 0) in rows and (9, 11, zlib.crc32(b"one")) in rows
    assert sharding.shard_documents(none).count() == 0
    sharding.write_shards(sharded, str(tmp_path / "out"))
    assert odd.sparkSession.read.parquet(str(tmp_path / "out")).count() == odd.count()


# 3


def shingles(text):
    found = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def test_fingerprints_next_to_brute_force(small, monkeypatch):
    monkeypatch.setattr("sigloom.llm.ordered.BLOCK_BYTES", 50_000)
    rows = sorted(text_of(small), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in fingerprints.neighbours(small).collect()}
    errors = []
    for i, r in enumerate(rows):
        after = rows[(i + 1) % len(rows)].text
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + after[:half]
        a, b = shingles(r.text), shingles(edited)
        errors.append(abs(got[r.doc_id].near_edited - len(a & b) / max(1, len(a | b))))
        assert got[r.doc_id].n_chars == len(r.text) and got[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert np.mean(errors) < 0.05


@pytest.mark.parametrize("ids", [[None] * 60 + list(range(40)), list(range(300)), [7] * 100])
def test_blocks_follow_the_order(spark, monkeypatch, ids):
    monkeypatch.setattr(ordered, "RUN", 4)
    rows = [(d, f"text {i} of {d}") for i, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("h", F.xxhash64("text"))
    dealt, count = ordered.in_blocks(docs, "doc_id", "h", block_bytes=len(rows))
    blocks, guests = {}, {}
    for r in dealt.collect():
        (guests if r["_guest"] else blocks).setdefault(r["_block"], []).append((r["_key"], r.h))
    order = sorted(x for b in blocks.values() for x in b)
    assert len(order) == len(rows) and [x for b in sorted(blocks) for x in sorted(blocks[b])] == order
    assert count > 8 and max(map(len, blocks.values())) < len(rows) / 2
    filled = sorted(blocks)
    assert {b: g for b, g in guests.items()} == {b: [min(blocks[filled[(i + 1) % len(filled)]])] for i, b in enumerate(filled)}


def test_sketches_merge_and_estimate():
    a, b = ([f"w{i}" for i in range(s, s + 4000)] for s in (0, 2000))
    x, y = fingerprints.sketches([" ".join(a), " ".join(b)])
    whole = fingerprints.sketches([" ".join(a + b[2000:])])[0]
    assert abs(fingerprints.resemblance(x, y) - 1996 / 5996) < 0.12
    assert abs(fingerprints.distinct(x) / 3996 - 1) < 0.25
    assert fingerprints.containment(x, fingerprints.merge(x, y)) > 0.8
    assert (fingerprints.merge(x, y) == whole).mean() > 0.95
    assert (fingerprints.decode(fingerprints.encode(x)) == x).all()
    assert fingerprints.resemblance(x[:0], x[:0]) == 1.0 and fingerprints.resemblance(x[:0], x) == 0.0


def test_fingerprints_of_odd_rows(odd, none):
    got = fingerprints.neighbours(odd).collect()
    assert len(got) == odd.count() and len({r.fingerprint for r in got if r.doc_id in (1, 5)}) == 1
    assert fingerprints.neighbours(none).count() == 0 and fingerprints.neighbours(odd.filter("doc_id = 9")).first().near_next == 1.0
    per_source = fingerprints.merged(fingerprints.fingerprint(odd.select("doc_id", "text", "source")), "source")
    assert per_source.count() == 2


# 4


def brute_links(rows):
    sets = [(r.doc_id, shingles(r.text or ""), r.text) for r in rows]
    return {(a[0], b[0]) for i, a in enumerate(sets) for b in sets[:i] if (len(a[1] & b[1]) / len(a[1] | b[1]) >= 0.8 if a[1] | b[1] else a[2] == b[2])}


@pytest.mark.parametrize("block", [2, 1024])
def test_ngram_join_next_to_brute_force(spark, small, block):
    rows = [r for r in text_of(small)]
    base = rows[1].text.split()
    near = [(10_000 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for k in range(20, 32)]
    docs = small.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id bigint, text string"))
    rows = text_of(docs)
    links = brute_links(rows)
    parent = {r.doc_id: r.doc_id for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: r for r in ngramjoin.join(docs, block=block).collect()}
    assert {i: r.class_id for i, r in got.items()} == {i: root(i) for i in parent}
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in pair for pair in links) for i in parent}
    assert sum(r.keep for r in got.values()) == len({root(i) for i in parent})


def test_ngram_join_of_odd_rows(odd, none):
    kept = ngramjoin.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    assert kept.filter("doc_id IN (1, 4, 7, 9)").count() == 4
    assert ngramjoin.join(none).count() == 0 and ngramjoin.keep_one(none).count() == 0


def test_components_are_those_of_a_walk(spark):
    rng = np.random.default_rng(3)
    edges = [(f"n{a:03}", f"n{b:03}") for a, b in rng.integers(0, 200, (130, 2))] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    met = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: parent[x] for x in met}


def test_pruning_keeps_pairs_at_the_threshold():
    least = ngramjoin.least_matches()
    rng = np.random.default_rng(1)
    equal = rng.random((20_000, ngramjoin.HASHES)) < 0.85
    kept = np.ones(len(equal), bool)
    for n, m in least.items():
        kept &= equal[:, :n].sum(1) >= m
    assert kept.mean() > 0.999 and least[ngramjoin.HASHES] > 0.6 * ngramjoin.HASHES


# 5


def test_mix_meets_its_targets(small):
    rows = mixing.digest(small).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source_size, []).append(r)
        assert r.taken <= 2 * r["size"]
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in text_of(small)}
    assert sizes == {r.doc_id: r["size"] for r in rows}
    total = sum(r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    assert abs(sum({s: g[0].target for s, g in by.items()}.values()) - 1.5 * total) < 1
    for s, g in by.items():
        assert g[0].target <= 2 * s + 1e-6 and abs(sum(r.taken for r in g) - g[0].target) <= max(0.5 * largest, 1)
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in mixing.digest(small).collect()}


def iterated_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """The contract's rule, step by step: what exceeds a source's cap is shared by weight among the others until none is above."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full, target = set(), {}
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[n] for n in full)
        rest = [n for n in names if n not in full]
        target = {n: cap * sizes[n] for n in full} | {n: left * weight[n] / sum(weight[m] for m in rest) for n in rest}
        above = {n for n in rest if target[n] > cap * sizes[n]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("seed", range(6))
def test_targets_are_those_of_the_iterated_rule(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {(f"s{i}" if i else None): int(rng.integers(1, 10 ** int(rng.integers(1, 6)))) for i in range(int(rng.integers(1, 9)))}
    rows = [(n, size // 2) for n, size in sizes.items()] + [(n, size - size // 2) for n, size in sizes.items()]
    got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    want = iterated_targets(sizes)
    assert {n: s for n, (s, _) in got.items()} == sizes and {n: t for n, (_, t) in got.items()} == pytest.approx(want)


def test_text_outranks_a_column_named_size(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 99), (2, "d", "s", 99)], "doc_id bigint, text string, source string, size bigint")
    assert {r.doc_id: r["size"] for r in mixing.plan_mix(docs).collect()} == {1: 3, 2: 1}


def test_demand_is_inverted(spark):
    from pyspark.sql import functions as F

    parts = np.linspace(0.01, 0.99, 25).tolist()
    df = spark.createDataFrame([(p, c) for p in parts for c in range(3)], "p double, c int").withColumn("t", mixing.invert_demand(F.col("p"), F.col("c")))
    times = [t for t, _ in mixing.SCHEDULE]
    for r in df.collect():
        grid = np.linspace(0, r.t, 4001)
        w = np.interp(grid, times, [x[r.c] for _, x in mixing.SCHEDULE])
        full = np.linspace(0, 1, 4001)
        assert abs(np.trapezoid(w, grid) / np.trapezoid(np.interp(full, times, [x[r.c] for _, x in mixing.SCHEDULE]), full) - r.p) < 1e-3


def test_mix_of_odd_rows(odd, none):
    assert mixing.digest(odd).count() == odd.count() and mixing.digest(none).count() == 0
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert set(taken) <= {1, 4, 5, 7, 8, 9, None} and taken.get(8, 0) <= 2


# 6


def brute_removed(rows, n=suffixes.LENGTH):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - n + 1):
            if raw[at : at + n] in seen:
                gone[at : at + n] = True
            seen.add(raw[at : at + n])
        out[i] = (len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def order_of(doc_id):
    return (doc_id is not None, doc_id or 0)


def brute_rows(spark, rows):
    """brute_removed() of rows whose ids may repeat or be null: equal ids go by the hash of their texts."""
    hashed = [(r.doc_id, r.text or "", r.h) for r in spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "xxhash64(cast(coalesce(text, '') as binary)) AS h").collect()]
    hashed.sort(key=lambda r: (order_of(r[0]), r[2]))
    found = brute_removed([(i, text) for i, (_, text, _) in enumerate(hashed)])
    return sorted(((hashed[i][0], *found[i]) for i in found), key=lambda r: (order_of(r[0]), r[1:]))


def suffix_rows(found):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()), key=lambda r: (order_of(r[0]), r[1:]))


@pytest.mark.parametrize("chunk, bucket, blocks", [(1, 1, 4), (5_000, 500, 1), (2 << 20, 1 << 20, 4)])
def test_suffix_dedup_next_to_brute_force(spark, small, monkeypatch, chunk, bucket, blocks):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "PART", max(chunk, 4_000))
    monkeypatch.setattr(suffixes, "MOST_TASKS", 8)
    rows = [(r.doc_id, r.text) for r in text_of(small)][:60]
    passage = rows[3][1][:150]
    rows += [(500 + i, f"{rows[i][1][:60]} {passage} {rows[i + 1][1][:60]}") for i in range(12)] + [(900, "ab" * 400), (901, "x" * 350), (902, "é" * 99 + "x" * 200)]
    first, second, third, fourth = (rows[i][1][:150] for i in (20, 21, 22, 23))
    rows += [(700, first), (701, second), (705, second + third), (705, fourth + first), (705, second + third), (None, passage), (None, None), (None, passage + second), (703, ""), (704, None)]
    rows += [(800 + i, "x" * (95 + i)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert suffix_rows(suffixes.deduplicate(docs, True, blocks, bucket)) == brute_rows(spark, rows)


@pytest.mark.parametrize("records", [1, 3])
def test_suffix_dedup_over_arrow_batches(spark, records):
    line = "".join(chr(97 + i * i * 7 % 26) + str(i) for i in range(90))
    rows = [(i, line + " ends here" if i % 3 else "begins apart " + line) for i in range(9)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        assert suffix_rows(suffixes.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute_rows(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_suffix_dedup_keeps_text_ids(spark):
    got = {r.doc_id: r for r in suffixes.deduplicate(spark.createDataFrame([("b", "y" * 40 + "z" * 120), ("a", "z" * 120)], "doc_id string, text string")).collect()}
    assert got["a"].n_removed == 119 and got["b"].kept == b"y" * 40 and got["b"].n_removed == 120


def test_cover_meets_every_pair_of_strings():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))
    keys = np.sort(np.random.default_rng(5).integers(0, 1 << 48, 999, dtype=np.uint64))
    assert (suffixes.unpacked(suffixes.packed(keys, 6), 6) == keys).all()


def test_suffix_dedup_of_odd_rows(odd, none):
    got = {r.doc_id: r for r in suffixes.deduplicate(odd).collect()}
    assert got[2].n_bytes == 0 and got[3].n_removed == 0 and got[8].n_removed > 100_000 and suffixes.deduplicate(odd).count() == odd.count()
    assert suffixes.deduplicate(none).count() == 0


# 7


def test_token_ids_round_trip(small, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr("sigloom.llm.ordered.BLOCK_BYTES", 50_000)
    monkeypatch.setattr("sigloom.llm.tokenids.SEGMENT_IDS", 20_000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, start = Tokenizer.from_file(path), 0
    got = {r.doc_id: r for r in tokenids.read_ids(tokenids.write_ids(small, path)).collect()}
    for r in sorted(text_of(small), key=lambda r: r.doc_id):
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pieces_encode_as_the_library_does():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        e = tokenids.Encoder(f.read())
    for text in ["", " ", "a<|endoftext|>b", "x² 1½ \x1c y\x85z", "日本語 text ǅ é́ a_b 12٣", "it's I'LL  two\n\n tabs\t\tend ", "\xa0 ª º µ ·", "🙂 ok"]:
        assert e.encode(text) == e.pack(e.tokenizer.encode(text, add_special_tokens=False).ids), text


def test_random_texts_encode_as_the_library_does():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        e = tokenids.Encoder(f.read())
    rng = np.random.default_rng(11)
    odd, plain = [chr(c) for c in range(0x300)], list("ab Z9_'\n\t.\x1c\x1d\x1e\x1f s")
    texts = [t.format(c) for c in odd for t in ("a{}b", " {}1", "{}'s", "\n{} \n", "_{}_")]
    texts += ["".join(rng.choice(plain if i % 2 else odd, int(rng.integers(1, 12)))) for i in range(6000)]
    wrong = [t for t in texts if e.encode(t) != e.pack(e.tokenizer.encode(t, add_special_tokens=False).ids)]
    assert not wrong


def test_elias_fano_selects_every_value():
    rng = np.random.default_rng(2)
    for values in ([0], [0, 0, 7, 7, 900], np.cumsum(rng.integers(0, 3000, 500)), np.zeros(130, int)):
        values = np.asarray(values)
        code = eliasfano.encode(values)
        reader = eliasfano.Reader(code)
        assert (reader.all() == values).all() and [reader[i] for i in range(len(reader))] == values.tolist()
        assert len(code) < 40 + len(values) * (3 + np.log2(max(2, values[-1] / len(values) + 1))) / 8 * 1.3


def test_token_ids_of_odd_rows(odd, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = tokenids.read_ids(tokenids.write_ids(odd, path)).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (2, 3)} == {1}
    assert tokenids.read_ids(tokenids.write_ids(none, path)).count() == 0


# 8


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be [nice] \\l <|end|>"), (1, 1, "user", None), (1, 2, "assistant", "</s>[INST] é\n"), (2, None, None, "x"), (2, 0, "assistant", ""), (2, 0, "assistant", "\\s\\")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = chat.canonical_turns(turns).unionByName(chat.canonical_turns(chat.probe(spark)))
    formatted = chat.format_turns(turns)
    got = {r.conv_id: r for r in chat.digest(formatted).collect()}
    said = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")], 1: [("system", rows[0][3]), ("user", ""), ("assistant", rows[2][3])], 2: [("", "x"), ("assistant", ""), ("assistant", "\\s\\")]}
    for conv, turn in said.items():
        loss = "".join(t for r, t in turn if r == "assistant")
        assert got[conv].n_turns == len(turn) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turn).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert all("[INST]" not in r.formatted and "</s>" not in r.formatted for r in formatted.collect())
    assert chat.digest(chat.format_turns(turns.limit(0))).count() == 0


def test_layouts_are_told_by_their_paths(spark):
    a = spark.createDataFrame([(1, "do", "more", "done")], "conv_id bigint, instruction string, input string, output string")
    assert [(r.role, r.text) for r in chat.canonical_turns(a).orderBy("turn").collect()] == [("user", "do\nmore"), ("assistant", "done")]
    b = spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")])], "conv_id bigint, conversations array<struct<`from`:string,value:string>>")
    assert [(r.role, r.text) for r in chat.canonical_turns(b).orderBy("turn").collect()] == [("user", "hi"), ("assistant", "yo")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id bigint, other string"))
    mixed = [(1, '{"prompt":"p","response":"r"}'), (2, '{"messages":[{"role":"user","content":"c"},{"role":"assistant","content":"d"}]}'), (3, '{"output":"o","instruction":"i"}')]
    got = chat.canonical_json(spark.createDataFrame(mixed, "conv_id bigint, record string")).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.role, r.text) for r in got] == [(1, "user", "p"), (1, "assistant", "r"), (2, "user", "c"), (2, "assistant", "d"), (3, "user", "i"), (3, "assistant", "o")]


def test_records_are_told_by_all_their_elements(spark):
    def read(*records):
        return [(r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_json(spark.createDataFrame(list(enumerate(records)), "conv_id bigint, record string")).orderBy("conv_id", "turn").collect()]

    mixed = '{"messages":[{"role":"user","content":"c"},{"role":"tool","content":"d","name":"n"},{"role":"assistant"}]}'
    assert read(mixed, '{"messages":[]}', '{"conversations":[]}', '{"turn":7,"role":"user","text":"t","other":1}') == [(0, 0, "user", "c"), (0, 1, "tool", "d"), (0, 2, "assistant", None), (3, 7, "user", "t")]
    for bad in ('{"messages":[{"said":"x"}],"prompt":"p"}', '{"a":1}', "no json"):
        with pytest.raises(Exception, match="no mapping"):
            read(bad)


def test_turn_rows_with_clashing_columns_and_repeats(spark):
    rows = [(1, t, "user", f"text {t}", "p", "m", 3, "h") for t in range(3000)] + [(2, 0, "user", "same", "p", "m", 3, "h")] * 3 + [(None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, prompt string, m string, nth int, head string")
    assert chat.choose(chat.known_paths(["role", "text", "turn"])) is not None and chat.choose(["role", "turn"]) is None
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(chat.canonical_turns(docs))).collect()}
    assert {i: r.n_turns for i, r in got.items()} == {1: 3000, 2: 3, None: 1}
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"user\ntext {t}\n" for t in range(3000)).encode()).hexdigest()


# 9


def test_leaks_are_found_and_clean_texts_left(spark, small, odd, none):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rng = np.random.default_rng(4)
    planted = []
    for n, (item, text) in enumerate(items[:15]):
        raw = list(text)
        for at in rng.integers(0, len(raw), len(raw) // 25):
            raw[at] = "z"
        planted.append((5000 + n, f"some words before {''.join(raw)} and after"))
    docs = small.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    exact = {(r.doc_id, i) for r in text_of(docs) for i, t in items if decontamination.normal(t) in decontamination.normal(r.text)}
    assert got == exact | {(5000 + n, items[n][0]) for n in range(15)}
    clean = decontamination.keep_clean(docs, bench)
    assert clean.count() == docs.count() - len({d for d, _ in got})
    assert decontamination.find_leaks(odd, bench).count() == 0 and decontamination.keep_clean(odd, bench.limit(0)).count() == odd.count()
    assert decontamination.find_leaks(none, bench).count() == 0
    own = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, LONG[:400])], "item_id bigint, text string")
    assert {r.doc_id for r in decontamination.find_leaks(odd, own).collect()} == {4, 8, 9}


def test_short_items_and_places_of_leaks(spark, monkeypatch):
    long = " ".join(f"tok{i}" for i in range(40))
    items = [("five", "a-b+c"), ("seven", "seven77"), ("eight", "eight888"), ("long", long), ("none", None), ("empty", " ")]
    docs = [("d1", f"x a-b+c y seven77, eight888."), ("d2", "xa-b+c seven777 eight8889"), ("d3", f"{long} and then {long} {long[:90]}"), (None, "SEVEN77")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    table = spark.createDataFrame(docs, "doc_id string, text string")
    want = {("d1", "five"), ("d1", "seven"), ("d1", "eight"), ("d2", "eight"), ("d3", "long"), (None, "seven")}
    for size in (1, 60, 2 << 20):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        got = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(table, bench).collect()}
        assert set(got) == want
        at = got["d3", "long"]
        assert (at.edits, at.end - at.begin) == (0, len(long)) and decontamination.normal(docs[2][1])[at.begin : at.end].decode() == long
        assert decontamination.keep_clean(table, bench).count() == 0


# 10


def test_articles_are_extracted(spark):
    page = """<html><head><title>t</title></head><body class="page-menu"><div class="top-menu"><a href=x>Home</a></div><aside>side</aside>
    <main><h1>Big &amp; small</h1><div><p>First   paragraph &eacute; with <a href=y>a link</a> inside.<br>next line</p><form>search</form><ul><li>point one of it</li></ul></div>
    <p>Second paragraph has quite a few words too.</p><div id="comments"><p>I disagree with all of this, says a reader.</p></div></main>
    <script>var x = "<p>no</p>";</script><footer>end</footer></body></html>"""
    want = "Big & small\n\nFirst paragraph é with a link inside. next line\n\npoint one of it\n\nSecond paragraph has quite a few words too."
    assert html.extract(page, html.DEFAULT) == want
    assert html.extract(page.replace("main>", "div>"), html.DEFAULT) == want
    rows = [(1, "u", page, 3), (1, "u", page, 3), (2, None, None, 3), (3, "u", "", 3), (4, "u", "<p>cut off in the mid", 3), (5, "u", "no tags at all", 3), (6, "u", "<p>unclosed <b", 3)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, want), (1, want), (2, ""), (3, ""), (4, "cut off in the mid"), (5, "no tags at all"), (6, "unclosed")]
    assert all(r.n_chars == len(r.text) for r in got)


def test_the_region_is_the_best_of_all():
    rng = np.random.default_rng(3)
    for _ in range(200):
        found = [("text", "w " * int(rng.integers(0, 4)), "") if rng.random() < 0.5 else (("open", "close")[rng.integers(2)], ("p", "li", "ul", "a")[rng.integers(4)], "") for _ in range(int(rng.integers(1, 14)))]

        def total(tokens, weights=html.DEFAULT):
            # Links opened before a region count in it, as in the scan.
            return sum(each[i] for i in tokens)

        each, links = [], 0
        for kind, name, _ in found:
            if kind == "text":
                each.append(len(name.split()) * html.DEFAULT["linked" if links else "word"])
            else:
                each.append(html.DEFAULT.get(name, html.DEFAULT["other"]))
                if name == "a":
                    links = links + 1 if kind == "open" else max(0, links - 1)
        best = max((total(range(a, b)) for a in range(len(found)) for b in range(a, len(found) + 1)), default=0)
        start, end = html.best_region(found, html.DEFAULT)
        assert total(range(start, end)) == pytest.approx(max(best, 0))


ARTICLE = " ".join(f"word{i}" for i in range(200))


@pytest.mark.parametrize(
    "page, rest",
    [
        ('<body><nav><a>m</a></nav><div class="content has-sidebar"><p>{}</p></div><footer>f</footer>', ""),
        ('<div class="page with-header"><header>H</header><article><p>{}</p><div class="share-buttons">share me</div></article></div>', ""),
        ('<div class="post social-enabled"><main><p>{}</p></main></div><div class="sidebar">side stuff</div>', ""),
        ('<section class="legal-news"><p>{}</p></section><div class="cookie-notice">we use cookies</div>', ""),
        ('<div class="search-result-article"><p>{}</p></div>', ""),
        ('<article><h1>T</h1><p>{}</p></article><section class="comments"><article class="comment"><p>nice post mate</p></article></section>', "T\n\n"),
        ('<form id="aspnetForm"><div><article><p>{}</p></article></div></form>', ""),
        ('<article><p class="notice">note here<p>{}</p><ul><li class="share">tweet<li>one</ul></article>', "\n\none"),
        ("<nav><ul><li>menu<div><article><p>{}</p></article></div>", ""),
    ],
)
def test_classes_alone_cut_no_article(page, rest):
    assert html.extract(page.format(ARTICLE), html.DEFAULT).replace(ARTICLE, "") == rest


def test_weights_are_learned_from_marked_pages(spark):
    page = '<div class="zoo">{0} outside</div><ul><li><a>menu</a><li><a>more</a></ul><article class="tale"><p>{1}</p><blockquote>{1}</blockquote></article>'
    pages = [page.format(f"promo {i}", ARTICLE) for i in range(30)]
    weights = html.learn(pages)
    assert weights[".zoo"] > html.CUT > 0 > weights[".tale"] and weights["blockquote"] > weights["li"] and weights["word"] > 1 and weights["linked"] == 0.1
    # On a page that marks nothing, what was learned of the class decides.
    bare = f'<div class="zoo">one two three</div><div class="tale"><p>{ARTICLE}</p></div>'
    assert html.extract(bare, weights) == ARTICLE != html.extract(bare, html.DEFAULT)
    rows = [(i, "u", p) for i, p in enumerate(pages)] + [(None, "u", "<article>x</article>"), (0, "u", "<article>y</article>"), (77, "u", None)]
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert html.fit(docs, 20) == html.fit(docs.repartition(3), 20) and html.fit(docs, 500)["word"] > 1
    assert html.learn([]) == html.DEFAULT == html.fit(docs.limit(0))


def test_long_pages_stay_whole():
    long = "\n".join(f"<p>{ARTICLE} {i}</p>" for i in range(3000))
    text = html.extract(f"<nav>menu</nav><article>{long}</article><footer>f</footer>", html.DEFAULT)
    assert text.count("word199") == 3000 and text.endswith(" 2999")


# Pipeline


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "mixing", "sharding"]
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.collect()
    leaks = {r.doc_id for r in decontamination.find_leaks(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert rows and not leaks & {r.doc_id for r in rows}
    assert not brute_links([r for r in {r.doc_id: r for r in rows}.values()])


@pytest.mark.parametrize("columns", [[], ["shard int", "slot bigint", "position double", "h bigint"]])
def test_pipeline_of_odd_inputs(spark, tmp_path, columns):
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(None, None, None, None, None), (900_001, None, "en", "src0", 0), (900_002, "", "en", None, 0), (900_003, "same row", "en", "src0", 8), (900_003, "same row", "en", "src0", 8), (900_004, LONG, None, "src1", 1)]
    for name, docs in (("odd", small.limit(60).union(spark.createDataFrame(odd, small.schema))), ("none", small.limit(0))):
        for c in columns:
            docs = docs.withColumn(c.split()[0], F.lit(1).cast(c.split()[1]))
        at = str(tmp_path / name)
        docs.write.parquet(f"{at}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{SMALL}/{table}.parquet").write.parquet(f"{at}/{table}.parquet")
        out = corpus_pipeline.run(spark, at)
        assert out.columns == [*[c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot"]
        rows = out.collect()
        assert (len(rows) > 0) == (name == "odd")
        if rows:
            ids = [r.doc_id for r in rows]
            assert ids.count(900_003) <= 2 and 900_004 in ids and None not in ids
            sizes = [sum(r.shard == k for r in rows) for k in range(24)]
            assert max(sizes) - min(sizes) <= 1


def test_words_are_those_of_a_pattern():
    for text in ["", "One two_three", "é—à 12,5 X", "a " * 3000]:
        assert len(words.shingle_sets([text])[0]) == len(shingles(text))
