"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mentora.llm.bpe import default_vocabulary, encoder
from mentora.llm.chat import conversation_digests, fold, format_conversations, parse, render, turn_events
from mentora.llm.components import connected_components
from mentora.llm.decontam import contamination, drop_contaminated, nearest_window, prefix_distance
from mentora.llm.lm import MappedTable, lm_scores, mix, unmix
from mentora.llm.media import clips, decode_files, encode_media, encode_slice, media_features
from mentora.llm.ngram_join import jaccard_components, keep_one
from mentora.llm.packing import best_fit_plan, pack_documents
from mentora.llm.pii import personal_data, redact
from mentora.llm.quality import fit, keep_good, quality_scores
from mentora.llm.token_counts import UnigramCounter, default_pieces, token_counts
from mentora.llm.token_files import token_table

SCHEMA = "doc_id long, text string, key string, node long, bit int"
WORDS = ["the", "of", "and", "river", "stone", "light", "house", "walked", "under", "never", "again", "bright", "small", "green", "silent", "winter"]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def sample():
    rows = [(i, prose(i, 30 + 7 * i)) for i in range(12)]
    rows += [(20, rows[3][1]), (21, rows[3][1] + " end"), (22, "  odd \t spaces\n\nhere "), (23, ""), (24, None), (25, "One"), (26, "ONE"), (None, "no id"), (27, "é ñ 中文 x² <|endoftext|>"), (28, prose(99, 4000)), (25, "One")]
    return [(d, t, "k", 1, 0) for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_is_exact():
    e, texts = encoder(default_vocabulary()), [t for _, t, *_ in sample()] + ["don't 'sable", "a\nb c", "a b", "x​y z"]
    got = [ids[a:b] for _, _, ids, at in e.column_ids(pa.array(texts)) for a, b in zip(at[:-1], at[1:])]
    assert all(np.array_equal(g, e.whole(t or "")) for g, t in zip(got, texts))


def test_media_round_trip(docs, empty):
    got = {(r.doc_id, r.n_bytes): r for r in media_features(encode_media(docs)).collect()}
    for d, t, *_ in sample():
        b = (t or "").encode()
        padded = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        r = got[d, len(b)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert media_features(encode_media(empty)).count() == 0
    data = np.random.default_rng(0).integers(0, 256, 64 * 40, dtype=np.uint8)
    samples, rows, facts = decode_files(encode_slice(data, np.array([0, len(data)])))[0]
    assert np.array_equal(samples, data) and sum(rows) == 40 and facts["n_bytes"] == len(data)
    assert clips(encode_media(docs)).where("n_frames < 1").count() == 0


def test_token_counts(docs, empty):
    counter = UnigramCounter(default_pieces())

    def best(word):
        state = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(state[b][0] + counter.score[word[b:end]], b, state[b][1] + 1) for b in range(max(0, end - counter.longest), end) if word[b:end] in counter.score]
            if word[end - 1] not in counter.score:
                size = len(word[end - 1].encode())
                options.append((state[end - 1][0] + size * counter.byte_score, end - 1, state[end - 1][1] + size))
            top = max(o[0] for o in options)
            state.append(next((o[0], o[2]) for o in options if o[0] == top))
        return state[-1][1]

    got = Counter(map(tuple, token_counts(docs).collect()))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert got == Counter((d, len(words(t)), sum(best("▁" + w) for w in words(t))) for d, t, *_ in sample())
    assert token_counts(empty).count() == 0


def test_packing(docs, empty):
    rows = pack_documents(docs, 64).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    e = encoder(default_vocabulary())
    assert sum(r.length for r in rows) == sum(len(e.whole(t or "")) + 1 for _, t, *_ in sample())
    assert pack_documents(empty).count() == 0
    sizes = np.random.default_rng(3).integers(1, 65, 500).tolist()
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [x for x in left if x >= s]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - s)
        else:
            left.append(64 - s)
    plan = best_fit_plan(dict(Counter(sizes)), 64)
    assert max(first + (b - a - 1) // each for _, a, b, first, each, _ in plan.tolist()) + 1 == len(left)


def test_quality(spark, docs, empty):
    good, bad = [(i, prose(i, 60)) for i in range(60)], [(100 + i, "BUY!! " * (20 + i)) for i in range(60)]
    table = spark.createDataFrame(good + bad + [(500, ""), (501, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 100)) for d, _ in good + bad], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_scores(table, labels).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 500]
    assert held and all(r.predicted == (r.doc_id < 100) for r in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert quality_scores(empty, labels).count() == 0
    assert quality_scores(table, labels.limit(0)).where("predicted = 0").count() == 0
    assert fit(np.zeros((3, 18)), np.ones(3, int)).scores(np.zeros((1, 18)))[0] == pytest.approx(0.5)


def test_decontamination(spark, docs, empty):
    item = prose(7, 30)
    words = item.split()
    near = " ".join([*words[:10], "changed", *words[11:20], *words[21:]])
    rows = [(1, prose(50, 80) + " " + item.upper() + "! " + prose(51, 20)), (2, prose(52, 40) + " " + near), (3, prose(53, 200)), (4, None), (5, ""), (None, item)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(9, item), (10, None), (11, "")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id, r.distance) for r in contamination(table, benchmark).collect()) == [(0, 9, 0), (1, 9, 0), (2, 9, 2)]
    assert {r.doc_id for r in drop_contaminated(table, benchmark).collect()} == {3, 4, 5}
    assert contamination(empty, benchmark).count() == 0 and contamination(table, benchmark.limit(0)).count() == 0
    assert prefix_distance(np.array([1, 2, 3], np.uint64), np.array([1, 3, 9], np.uint64)) == 1


def test_decontamination_finds_long_edited_items(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    items, rows = {}, []
    for i in range(48):
        length = (60, 100, 200, 300, 600)[i % 5]
        items[i], most = fresh(length), int(0.15 * length)
        words, places = list(items[i]), range(length) if i % 2 else range(2 * most)  # spread, or all near the start
        for k, at in enumerate(sorted(rng.choice(places, most, replace=False).tolist(), reverse=True)):
            words[at : at + (k % 3 != 1)] = [] if k % 3 == 2 else fresh(1)
        rows.append((i, " ".join(fresh(30) + words + fresh(30))))
    table, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    got = {r.doc_id: r for r in contamination(table, benchmark).collect()}
    assert set(got) == set(items) and drop_contaminated(table, benchmark).count() == 0
    number = lambda ws: np.array([zlib.crc32(w.encode()) for w in ws], np.uint64)
    for i in range(0, 48, 16):
        item, text = number(items[i]), number(rows[i][1].split())
        best = min((prefix_distance(item, text[k:]), k) for k in range(len(text)))
        assert (got[i].distance, got[i].start_word) == best == nearest_window(item, text)


def test_lm_probabilities(spark, docs, empty):
    x = np.random.default_rng(1).integers(0, 2**63, 100, dtype=np.uint64)
    assert np.array_equal(unmix(mix(x)), x)
    rows = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_scores(docs).collect()]
    fold_of = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [(d, [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]) for d, t, *_ in sample()]
    counts = Counter(w for d, ws in tokens if not fold_of(d) for w in ws)
    pairs = Counter(p for d, ws in tokens if not fold_of(d) for p in zip(["<s>", *ws], ws))
    n, v = sum(counts.values()), len(counts)
    follow = Counter(w for _, w in pairs)

    def cuts(values):
        c = [Counter(values)[k] for k in (1, 2, 3, 4)]
        if not all(c):
            return 0, 0.5, 1.0, 1.5
        y = c[0] / (c[0] + 2 * c[1])
        return 0, *(min(max(k - (k + 1) * y * c[k] / c[k - 1], 0), k) for k in (1, 2, 3))

    high, lower = cuts(pairs.values()), cuts(follow.values())
    rest = sum(lower[min(k, 3)] for k in follow.values()) / len(pairs)
    by = defaultdict(list)
    for (a, _), k in pairs.items():
        by[a].append(k)

    def prob(a, w):
        p = max(follow[w] - lower[min(follow[w], 3)], 0) / len(pairs) + rest / (v + 1)
        if a in by:
            k = pairs[a, w]
            p = (max(k - high[min(k, 3)], 0) + sum(high[min(x, 3)] for x in by[a]) * p) / sum(by[a])
        return p

    want = Counter((d, fold_of(d), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6), round(sum(np.log10(prob(a, w)) for a, w in zip(["<s>", *ws], ws)), 6)) for d, ws in tokens)
    assert Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in rows) == want
    assert lm_scores(empty).count() == 0 and MappedTable("", [], 4, 1).find(x[:3])[0].tolist() == [-1, -1, -1]


def brute_components(rows, k, num, den):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 4, 5)])
def test_jaccard_components(spark, k, num, den, monkeypatch):
    import mentora.llm.ngram_join as join

    monkeypatch.setattr(join, "BLOCK", 4)
    if k == 5:
        monkeypatch.setattr(join, "PART_ELEMENTS", 400)  # clusters in several parts
    rng, rows = np.random.default_rng(5), []
    for g in range(6):
        base = rng.choice(WORDS, 60 + 40 * g).tolist()
        for _ in range(14):
            own = list(base)
            for _ in range(rng.integers(0, 8)):
                own[rng.integers(len(own))] = f"w{rng.integers(1000)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000, rows[0][1]), (1001, None), (1002, ""), (1003, "just two"), (1004, "Just TWO")]
    repeats = rows[:20] if k == 4 else []
    table = spark.createDataFrame(rows + repeats, "doc_id long, text string").repartition(3)
    want = brute_components(rows, k, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(table, k, num, den).collect()} == want
    assert sorted(r.doc_id for r in keep_one(table, k, num, den).collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def test_jaccard_edges(docs, empty):
    got = Counter(map(tuple, jaccard_components(docs).collect()))
    assert sum(got.values()) == len(sample()) and got[25, 1, 25] == 2 and got[26, 1, 25] == 1 and got[24, 0, 24] == 1
    assert jaccard_components(empty).count() == 0


def test_jaccard_links_sets_without_ids(spark):
    words = prose(3, 60).split()
    a, b, c = " ".join(words), " ".join([*words, "x1"]), " ".join([*words, "x1", "x2"])
    rows = [(4, a), (None, b), (None, b), (9, c), (None, prose(4, 30)), (None, prose(4, 30))]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, "doc_id long, text string")
        got = Counter((r.doc_id, r.component_id) for r in jaccard_components(table, 5, 96, 100).collect())
        assert got == {(4, 4): 1, (None, 4): 2, (9, 4): 1, (None, None): 2}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i % 10 != 9] + [(5, 5)], "a long, b long")
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(i, i // 10 * 10) for i in range(31) if i < 30}


def test_token_files(docs, empty):
    rows = sorted(map(tuple, token_table(docs).collect()), key=lambda r: r[1])
    e, at = encoder(default_vocabulary()), 0
    assert [r[0] for r in rows] == sorted((d for d, *_ in sample()), key=lambda d: -1 if d is None else d)
    texts = defaultdict(set)
    for d, t, *_ in sample():
        ids = np.append(e.whole(t or ""), np.uint32(0)).astype("<u4")
        texts[d].add((len(ids), zlib.crc32(ids.tobytes())))
    for d, start, n, crc in rows:
        assert start == at and (n, crc) in texts[d]
        at += n
    assert token_table(empty).count() == 0


def test_chat(spark):
    bad = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "user", bad, 0), (1, 1, "assistant", bad, 0), (2, 0, "system\n", "a\\b", 0), (2, 1, None, None, 0), (2, 2, "assistant", "x", 0), (2, 2, "assistant", "x", 0), (None, 0, "user", "y", 0)]
    got = {r.conv_id: r for r in conversation_digests(format_conversations(turn_events(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, step int")))).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (2, len(bad), hashlib.sha256(bad.encode()).hexdigest())
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{bad}\nassistant\n{bad}\n".encode()).hexdigest()
    assert (got[2].n_turns, got[2].loss_chars) == (4, 2) and got[2].turns_sha256 == hashlib.sha256(b"system\n\na\\b\n\n\nassistant\nx\nassistant\nx\n").hexdigest()
    log = [("start", 1, "user", ""), ("delta", 1, None, "he"), ("delta", 1, None, "y"), ("start", 2, "assistant", ""), ("delta", 2, None, "no"), ("start", 3, "user", "z"), ("regenerate", 2, None, None), ("delta", 2, None, "yes"), ("edit", 1, None, "hi"), ("delta", 9, None, "?")]
    assert fold(iter(log)) == [("user", "hi"), ("assistant", "yes")] and parse(render(fold(iter(log)))[0]) == fold(iter(log))


def test_pii(spark, empty):
    texts = ["mail a.b@c.de, x@y.z.w@q.rs!", "ip 1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "call +1 (555) 010-9999 or +1 23", "é中 +44 20 7946 0958 é", "", None, "9" * 3000, "a" * 5000 + "@"]
    texts += [f"hotline {p} now" for p in ("+1 212 555 0100", "+1 212 555 0101", "+1 212 555 0102", "+1 212 555 0103", "+1 212 555 0104", "+1 212 555 0105")] + ["hotline (212) 555-0199 now", "sold (212) 555-0199 pieces and others"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "card":
            twice = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
            return 13 <= len(d) <= 19 and twice % 10 == 0
        return kind == "email" or (all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else 9 <= len(d) <= 15)

    for d, t in rows:
        spans = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t or "") if valid(k, m.group())]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and (got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone) == tuple(sum(s[0] == k for s in spans) for k in patterns)
        assert set(filter(None, text.split(","))) <= set(got[d].spans.split(","))
    assert got[len(texts) - 2].spans == "phone:8:22"
    clean = {r.doc_id: r.text for r in redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[4] == "é中 [PHONE] é" and clean[6] is None and clean[5] == "" and "(212)" not in clean[len(texts) - 2]
    assert personal_data(empty).count() == 0


def test_pii_discovers_planted_identifiers(spark, monkeypatch):
    """Keys in other alphabets than the seeds', and phone numbers without +, found by the labels that seeds stand beside."""
    import mentora.llm.pii as pii

    monkeypatch.setattr(pii, "SEED_SHARE", 1)  # all eight hexadecimal keys
    rng = np.random.default_rng(11)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(8)]
    keys = ["".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZ"), 14)) + f"_{rng.integers(10**6, 10**7)}" for _ in range(10)]
    text = lambda i: prose(i, 40)
    rows = [(i, f'{text(i)} token = "{h}" {text(i + 50)}') for i, h in enumerate(hexes)]
    planted = [(100 + i, f'{text(i + 9)} token = "{k}" {text(i + 70)}') for i, k in enumerate(keys[:6])]
    decoys = [(200 + i, f"{text(i + 30)} batch {k} {text(i + 90)}") for i, k in enumerate(keys[6:])]
    everything = rows + planted + decoys + [(300, None), (301, ""), (None, rows[0][1]), rows[1], (302, "river " * 20000)]
    table = spark.createDataFrame([(*r, "mine", "x", 5) for r in everything], "doc_id long, text string, row_key string, spans string, n_chars int")
    got = Counter((r.doc_id, r.spans, r.n_spans) for r in personal_data(table).collect())
    found = {d for d, _, n in got if n}
    at = lambda t, v: f"secret:{t.index(v)}:{t.index(v) + len(v)}"
    assert found == {d for d, _ in rows + planted} | {None}  # recall and precision 1
    assert all(got[d, at(t, k), 1] == (2 if d == 1 else 1) for (d, t), k in zip(rows + planted, hexes + keys))
    clean = Counter(redact(table).collect())
    assert sum(clean.values()) == len(everything) and all(r.row_key == "mine" and r.spans == "x" for r in clean)
    assert {r.doc_id: r.text for r in clean}[103] == planted[3][1].replace(keys[3], "[SECRET]")
    assert {r.doc_id: (r.text, r.n_chars) for r in clean}[300] == (None, 5)
    assert redact(table.limit(0)).count() == 0


def test_pii_discovers_keys_without_seeds_of_their_own(spark):
    """Half of the keys are seeds by their checksum; the others are found by context alone, behind words of any length and
    with whatever stands around. Keys beside other words stay."""
    rng = np.random.default_rng(5)
    keys = ["".join(rng.choice(list("0123456789abcdef"), 40 + 300 * (i % 5 == 0))) for i in range(40)]
    text = lambda i: prose(i, 30)
    filler = "w" * 400  # longer than the characters that are searched first
    near = [(i, f'{text(i)} {filler if i % 3 == 0 else "plain"} token = "{k}" {text(i + 50)}' if i % 7 else f'token = "{k}"') for i, k in enumerate(keys)]
    decoys = [(100 + i, f"{text(i)} batch {k[:20]}x7 {text(i + 5)}") for i, k in enumerate(keys)]
    seeds = {i for i, k in enumerate(keys) if zlib.crc32(k.encode()) % 2 == 0}
    assert 10 < len(seeds) < 30
    got = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(near + decoys, "doc_id long, text string")).collect()}
    assert all(got[d] == f"secret:{t.index(keys[d])}:{t.index(keys[d]) + len(keys[d])}" for d, t in near)  # recall 1 of 40 - len(seeds)
    assert not any(got[d] for d, _ in decoys)


def test_pii_contexts_are_whole_words(spark):
    import mentora.llm.pii as pii

    long, key = "L" * 500, "1.2.3.4"
    texts = [f"a {long} b {key} c d", f"{long} {key}({long} {long} x", f"{key} {long}", f"p {long} ({long}{key} after", key, f" \t{key}\n", f"x\ty\n\n{key}"]
    rows = spark.createDataFrame([(i, t, [(1, t.index(key), t.index(key) + len(key), key)]) for i, t in enumerate(texts)], f"i int, text string, s {pii.SPAN}")
    got = {r.i: (r.x.before, r.x.before2, r.x.after) for r in rows.select("i", pii._with_contexts(F.col("text"), F.col("s"))[0].alias("x")).collect()}
    low = long.lower()
    assert got == {0: ("b", f"{low} b", "c"), 1: (low, None, low), 2: (None, None, low), 3: (low, f"p {low}", "after"), 4: (None, None, None), 5: (None, None, None), 6: ("y", "x y", None)}


def test_chat_log_is_real(spark):
    """The log holds edits and regenerations that change what a plain run over its texts would give, and any order folds alike."""
    turns = [(1, 0, "user", "abc"), (1, 1, "assistant", "defg"), (1, 2, "user", ""), (1, 3, "assistant", None), (2, 0, "assistant", "x" * 100_001)]
    log = turn_events(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert Counter(r.event for r in log.collect()) == {"start": 8, "delta": 19, "edit": 2, "regenerate": 6}
    shuffled = log.orderBy(F.xxhash64("text", "event", "message")).repartition(3)
    a, b = ({r.conv_id: r.formatted for r in format_conversations(x).collect()} for x in (log, shuffled))
    assert a == b and [parse(a[1]), parse(a[2])] == [[(r, t or "") for c, _, r, t in turns if c == k] for k in (1, 2)]
    assert format_conversations(log.limit(0)).count() == 0 and turn_events(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    many = [("start", i, "user", "t") for i in range(20_000)] + [("regenerate", 0, None, "")] + [("start", -i - 1, "user", "t") for i in range(20_000)]
    assert len(fold(iter(many))) == 20_001


def test_selective_reads_of_token_files(spark, tmp_path):
    import pyarrow.parquet as pq

    from mentora.llm.storage import arrow_batches
    from mentora.llm.token_files import read_tokens, write_token_files

    rows = [(i, prose(i, 40)) for i in range(400)] + [(7, "again"), (None, "none")]
    path = f"file://{tmp_path}/tokens"
    with arrow_batches(spark, 50):
        write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, group_tokens=2000).collect()
    e = encoder(default_vocabulary())
    got = Counter((r.doc_id, tuple(r.ids)) for r in read_tokens(spark, path, 5, 8).collect())
    assert got == Counter((d, (*e.whole(t).tolist(), 0)) for d, t in rows if d is not None and 5 <= d <= 8)
    meta = read_tokens(spark, path, low=390, ids=False)
    assert sorted(r.doc_id for r in meta.collect()) == list(range(390, 400)) and read_tokens(spark, path, ids=False).count() == len(rows)
    plan = meta._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,390)" in plan and "ids" not in plan.split("ReadSchema")[1]
    files = [pq.ParquetFile(f) for f in (tmp_path / "tokens").glob("*.parquet")]
    assert sum(f.num_row_groups for f in files) > len(files) and all(f.metadata.row_group(0).column(0).has_column_index and f.metadata.row_group(0).column(0).has_offset_index for f in files)
    assert "DELTA_BINARY_PACKED" in files[0].metadata.row_group(0).column(0).encodings


def test_bradley_terry_fit_is_the_optimum_of_the_pairs():
    """Against a plain gradient descent over all pairs, and the cut against every possible cut."""
    rng = np.random.default_rng(4)
    labels = np.array([1] * 12 + [0] * 9)
    features = np.where(labels[:, None] == 1, 0.8, 0.0) * np.array([1, -0.5, 0]) + rng.normal(size=(21, 3))
    model = fit(features, labels)
    x = ((features - features.mean(0)) / features.std(0)).clip(-8, 8)
    pairs = [x[a] - x[b] for a in np.flatnonzero(labels == 1) for b in np.flatnonzero(labels == 0)]
    draw = np.random.default_rng(7)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    sample = x[draw.choice(good, len(pairs))] - x[draw.choice(bad, len(pairs))]
    w = np.zeros(3)
    for _ in range(20_000):
        w += 0.05 * ((sample / (1 + np.exp(sample @ w))[:, None]).mean(0) - 1e-3 * w)
    assert np.allclose(w, model.weights, atol=1e-4)
    won = np.mean([d @ model.weights > 0 for d in pairs])
    raw = x @ model.weights
    balance = lambda c: np.mean(raw[labels == 1] >= c) + np.mean(raw[labels == 0] < c)
    assert won > 0.7 and balance(model.cut) == max(map(balance, [*raw, raw.max() + 1]))
    assert np.array_equal(model.scores(features) >= 0.3, raw >= model.cut)


def test_quality_edges(spark):
    good, bad = [(i, prose(i, 60)) for i in range(40)], [(100 + i, "BUY!! " * (20 + i)) for i in range(40)]
    odd = [(None, prose(1, 60)), (None, None), (3, prose(3, 60)), (3, "BUY!! " * 30), (400, ""), (401, "word " * 50_000)]
    table = spark.createDataFrame([(d, t, 1, 0.5, "f") for d, t in good + bad + odd], "doc_id long, text string, quality int, score double, features string").repartition(3)
    labels = spark.createDataFrame([(d, int(d < 100)) for d, _ in good + bad] + [(5, 0), (5, 1), (None, 1), (6, None), (7, 9)], "doc_id long, quality int")
    rows = quality_scores(table, labels).collect()
    assert len(rows) == 86 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    kept = keep_good(table, labels)
    assert kept.columns == table.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.predicted)
    once = spark.createDataFrame([(5, 1)], "doc_id long, quality int").union(labels.where("doc_id is null or doc_id != 5"))
    assert {(r.doc_id, r.score) for r in quality_scores(table, once).collect()} == {(r.doc_id, r.score) for r in rows}
    assert keep_good(table.limit(0), labels).count() == 0
