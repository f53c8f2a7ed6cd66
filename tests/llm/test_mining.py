"""Clustering, phrase mining and substring removal against brute force, with hard rows, and their SQL on the smallest tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import mentora.llm.centroids as centroids
import mentora.llm.phrases as phrases
import mentora.llm.repeats as repeats
from mentora.llm.queries import llm_oracle_sql, llm_queries

SF_DIR = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_phrase_mining", "op13_substring_dedup"])
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    ours, theirs = llm_queries()[name](spark, SF_DIR), db.sql(llm_oracle_sql()[name])
    assert Counter(map(tuple, ours.collect())) == Counter(theirs.select(*ours.columns).fetchall())
    assert spark.sql("SHOW TABLES").count() == 0


def brute_clusters(rows, k, rounds, dims, scale=1024, seed=3):
    rows = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(rows, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()), r[1]))
    centers = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers)) for _, v in rows]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centers)):
            mine = [v for (_, v), (_, o) in zip(rows, own) if o == j]
            if mine:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine)]
    own, inertia = assign(), Counter()
    for d, o in own:
        inertia[o] += d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, o, d, inertia[o], sum(inertia.values()), digests[o]) for (i, _), (d, o) in zip(rows, own))


@pytest.mark.parametrize(("dims", "k", "size"), [(2, 3, 10), (3, 5, 1 << 16), (1, 4, 3), (2, 200, 1)])
def test_delta_lloyd(spark, dims, k, size, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 7)
    r = random.Random(dims * k)
    odd = [None, float("nan"), float("inf"), -float("inf"), 1.0]
    rows = [(r.choice([None, i, i // 2]), [r.choice(odd) if r.random() < 0.02 else round(r.gauss(0, 1) * size, 1) for _ in range(dims + (r.random() < 0.05))]) for i in range(150)]
    rows += [(7, None), (8, []), *rows[:9]]
    table = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, part int, cluster int").repartition(5)
    got = centroids.delta_lloyd(table, k=k, rounds=6, dims=dims)
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows, k, 6, dims)
    assert centroids.delta_lloyd(table.limit(0), dims=dims).count() == 0


def test_delta_lloyd_is_exact_or_fails(spark):
    x = 2.0**18
    table = spark.createDataFrame([(i, [x, -x, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    rows = [(i, [x, -x, float(i)]) for i in range(4)]
    assert Counter(map(tuple, centroids.delta_lloyd(table, k=2, rounds=2, dims=3).collect())) == brute_clusters(rows, 2, 2, 3)
    with pytest.raises(Exception, match="too large"):
        centroids.delta_lloyd(table.withColumn("embedding", table.embedding.cast("array<double>")), k=2, dims=3, scale=1 << 14)


def test_reassign_compares_only_what_changed(monkeypatch):
    rng = np.random.default_rng(4)
    vectors, old = rng.integers(-50, 50, (300, 4)), rng.integers(-50, 50, (6, 4))
    owner, distance = centroids.reassign(vectors, np.full(300, centroids.NO_OWNER), np.zeros(300, np.int64), old, np.ones(6, bool))
    new, changed = old.copy(), np.array([False, True, False, False, True, False])
    new[changed] += 9
    compared = []
    whole = centroids.squared_distances
    monkeypatch.setattr(centroids, "squared_distances", lambda v, c: compared.append((len(v), len(c))) or whole(v, c))
    got = centroids.reassign(vectors, owner, distance, new, changed)
    lost = int(np.isin(owner, [1, 4]).sum())
    assert compared == [(lost, 6), (300 - lost, 2)]
    assert np.array_equal(got[0], whole(vectors, new).argmin(1)) and np.array_equal(got[1], whole(vectors, new).min(1))
    clusters, sums = centroids.transfers(vectors, owner, got[0])
    total = lambda o: np.stack([np.append(vectors[o == c].sum(0), (o == c).sum()) for c in range(6)])
    want = total(got[0]) - total(owner)
    assert all(np.array_equal(want[c], s) for c, s in zip(clusters, sums)) and not np.delete(want, clusters, 0).any()


def brute_phrases(rows, longest, least, share, top, scale=1_000_000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = Counter()
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        dropped = {p[i : i + s] for p, a in found.items() for s in range(2, len(p)) for i in range(len(p) - s + 1) if 100 * a >= share * count[p[i : i + s]]}
        ranked = []
        for p, a in found.items():
            if p not in dropped:
                score, _, x, y = min((scale * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), x, y))
        out.update((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(ranked)[:top]))
    return out


@pytest.mark.parametrize(("longest", "least", "share", "top"), [(2, 2, 50, 1000), (3, 2, 50, 20), (4, 3, 40, 1000), (3, 10, 50, 7)])
def test_phrases(spark, longest, least, share, top, monkeypatch):
    for name, value in {"GATHERED": 50, "CELL": 20, "PREFIX": 15, "REMEMBERED": 3}.items():
        monkeypatch.setattr(phrases, name, value)  # hot prefixes over several cells, rankings in groups
    r = random.Random(longest * least)
    bits = ["a", "B", "é", "İ", "the ", "of ", "x", " ", " ", "\t", ".", "!\n", "a b ", "中 "]
    rows = [(None if i % 13 == 0 else "".join(r.choice(bits) for _ in range(r.randint(0, 80))), r.choice(["en", "en", "en", None, "", "d e"])) for i in range(60)]
    rows += [("", "en"), (" .\n", "zz"), ("w" * 70_000 + " a b", "en"), ("a b " * 3000, "en"), *rows[:5]]
    table = spark.createDataFrame([(t, x, 1, "k", 2.0) for t, x in rows], "text string, lang string, n long, words string, a double").repartition(5)
    assert Counter(map(tuple, phrases.phrases(table, longest, least, share, top).collect())) == brute_phrases(rows, longest, least, share, top)
    assert phrases.phrases(table.limit(0)).count() == 0


def test_phrase_scores_pass_64_bits(spark):
    big = 4_000_000_000_000
    got = spark.range(1).select(phrases._exact_score(*[spark_lit(x) for x in (big - 1, big, big + 7)], 1_000_000).alias("s")).head().s
    assert got == 1_000_000 * (big - 1) ** 2 // (big * (big + 7))


def spark_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x).cast("long")


def test_growth_is_depth_first():
    rows = np.array([[1, 2, 3], [1, 2, 4], [1, 5, 3], [1, 6, int(phrases.NO_WORD)]], np.uint32)
    found = [(tuple(x for x in p.tolist() if x != int(phrases.NO_WORD)), int(n)) for ps, ns in phrases.grow(rows, np.array([2, 3, 4, 1]), 2, False) for p, n in zip(ps, ns)]
    assert found == [((1, 2), 5), ((1, 5), 4), ((1, 2, 3), 2), ((1, 2, 4), 3), ((1, 5, 3), 4)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_repeats(rows, window):
    texts = [words_of(t) for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = Counter()
    for (d, _), w in zip(rows, texts):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        spans = tuple(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        out[d, len(w), spans, " ".join(x for x, g in zip(w, gone) if not g)] += 1
    return out


@pytest.mark.parametrize("window", [2, 3, 4, 5, 8, 35])
def test_repeats(spark, window, monkeypatch):
    monkeypatch.setattr(repeats, "CELL_WORDS", 50)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 600)
    r = random.Random(window)
    rows = [(i, None if i % 17 == 0 else " ".join(r.choice("abcdé" if i % 3 else "ab") for _ in range(r.randint(0, 60))) + r.choice(["", " ", "\n"])) for i in range(80)]
    passage = " ".join(f"p{i % 70}" for i in range(90))  # repeats itself and others, at any offset
    rows += [(100 + i, " ".join(f"x{i}_{j}" for j in range(i)) + " " + passage) for i in range(20)]
    rows += [(None, "x y z"), (3, ""), (4, "Case differs case differs"), (5, "a " * 30_000), *rows[:5]]
    table = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, part int, spans string").repartition(3)
    got = repeats.repeated_spans(table, window)
    want = brute_repeats(rows, window)
    assert Counter((x.doc_id, x.n_words, tuple(map(tuple, x.spans)), x.kept) for x in got.collect()) == want
    digests = Counter(map(tuple, repeats.repeat_digests(got).collect()))
    assert digests == Counter({k: 0 for k in ()}) + Counter(x for (d, n, s, t), c in want.items() for x in [(d, n, sum(b - a for a, b in s), hashlib.sha256(t.encode()).hexdigest())] * c)
    assert repeats.repeated_spans(table.limit(0), window).count() == 0


def test_run_hashes_depend_on_words_alone():
    words = np.random.default_rng(1).integers(0, 2**63, 100, dtype=np.uint64)
    twice = np.concatenate([words, words[:50]])
    h = repeats.run_hashes(twice, np.arange(150 - 35 + 1), 35)
    assert np.array_equal(h[:16], h[100:116]) and len(set(h.tolist())) == 100
