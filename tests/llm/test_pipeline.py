"""Each stage of the corpus pipeline against brute force on its own input, the given tables with hard rows added."""

import re
import zlib

import numpy as np
import pandas as pd
import pytest
from test_llm import brute_components

import corpus_pipeline
from mentora.llm.bpe import default_vocabulary
from mentora.llm.decontam import nearest_window
from mentora.llm.pii import personal_data
from mentora.llm.quality import text_features, train_quality
from mentora.llm.words import NO_LETTER, word_hashes

SF_DIR = "/root/testdata/sf0.001"
#: Clashing names, so that a stage's own columns can't take theirs.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, spans string"


def as_bytes(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return data, np.array([0, len(data)])


def stages(spark, docs, sf_dir):
    """(name, input rows, output) of every stage, the output written and read again as in ``run``."""
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.write_table(stage(spark, docs, sf_dir), name)
        yield name, docs, out
        docs = out


@pytest.fixture(scope="module")
def found(spark):
    given = pd.read_parquet(f"{SF_DIR}/documents.parquet")
    rows = [(int(d), t, lang, source, n, int(d) % 3, "s") for d, t, lang, source, n in given.itertuples(index=False)]
    item = pd.read_parquet(f"{SF_DIR}/benchmark.parquet")["text"][0]
    plain = given["text"][0]
    rows += [(9001, plain, None, None, None, None, None), (9002, item, "en", "hot", 1, 1, ""), (9003, f"{plain} Write to someone.else@example.org now.", "en", "hot", 1, 1, "")]
    rows += [(9004, None, None, None, None, None, None), (9005, "", "en", "hot", 0, 0, ""), (None, "A text without a number.", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {name: (before.collect(), after.collect(), before.columns, after.columns) for name, before, after in stages(spark, docs, SF_DIR)}


def test_order_and_columns(found):
    assert list(found) == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii", "best_fit_packing"]
    for before, after, had, has in list(found.values())[:-1]:
        assert had == has and before and after


def test_quality(spark, found):
    before, after, *_ = found["quality_classifier"]
    model = train_quality(spark.createDataFrame(before, SCHEMA), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    assert sorted(map(str, after)) == sorted(str(r) for r in before if model.scores(text_features(*as_bytes(r.text)))[0] >= 0.3)
    labels = dict(pd.read_parquet(f"{SF_DIR}/labels.parquet")[["doc_id", "quality"]].itertuples(index=False))
    kept = {r.doc_id for r in after}
    right = [(r.doc_id in kept) == (labels[r.doc_id] == 1) for r in before if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert right and np.mean(right) >= 0.9


def test_near_copies(found):
    before, after, *_ = found["ngram_jaccard_join"]
    groups = brute_components([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5, 4, 5)
    want = [r for r in before if r.doc_id is None or groups[r.doc_id][0] == 0 or groups[r.doc_id][1] == r.doc_id]
    assert sorted(map(str, after)) == sorted(map(str, want))
    assert len(after) < len(before)


def test_contaminated(found):
    before, after, *_ = found["benchmark_decontamination"]
    words = lambda t: word_hashes(*as_bytes(t), NO_LETTER)[0]
    items = [words(t) for t in pd.read_parquet(f"{SF_DIR}/benchmark.parquet")["text"]]
    near = lambda t: any(len(x) and nearest_window(x, t)[0] <= int(0.15 * len(x)) for x in items)
    assert sorted(map(str, after)) == sorted(str(r) for r in before if not near(words(r.text)))


def test_redacted(spark, found):
    before, after, *_ = found["pii"]
    spans = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(before, SCHEMA).select("doc_id", "text")).collect()}
    now = {r.doc_id: r for r in after}
    assert len(before) == len(after) and any(spans.values())
    for r in before:
        assert now[r.doc_id].asDict() | {"text": 0, "n_chars": 0} == r.asDict() | {"text": 0, "n_chars": 0}
        assert now[r.doc_id].n_chars == (len(now[r.doc_id].text) if spans[r.doc_id] else r.n_chars)
        assert (now[r.doc_id].text == r.text) != bool(spans[r.doc_id])
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", now[r.doc_id].text or "")


def test_packed(found):
    from tokenizers import Tokenizer

    before, after, *_ = found["best_fit_packing"]
    encode = Tokenizer.from_file(default_vocabulary()).encode
    ids = {r.doc_id: [*encode(r.text or "", add_special_tokens=False).ids, 2] for r in before}
    for d, own in ids.items():
        pieces = sorted((r for r in after if r.doc_id == d), key=lambda r: r.piece)
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()] and sum(r.length for r in pieces) == len(own)
        assert all(r.length == 1024 for r in pieces[1:]) and [r.ids_crc32 for r in pieces] == [zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes()) for r in pieces]
    sequences = {}
    for r in after:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        ends = np.cumsum([n for _, n in places])
        assert ends[-1] <= 1024 and [o for o, _ in places] == [0, *ends[:-1].tolist()]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert all(stage(spark, docs, SF_DIR).count() == 0 for _, stage in corpus_pipeline.STAGES)
