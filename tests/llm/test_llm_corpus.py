"""N-gram join, SentencePiece coding, packing and the pipeline."""

import collections
import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given as hypothesis_given
from hypothesis import settings
from hypothesis import strategies as st

import corpus_pipeline
from odolake.llm import language_id, lp_packing, ngram_join, secret_scan, suffix_pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, n int, token string, component_id int"
TABLE = "/root/testdata/sf0.001/documents.parquet"


def docs(spark, given):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 1, "x", 1) for i, t in given], SCHEMA)


# --- n-gram Jaccard join ------------------------------------------------------

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def plain_join(given):
    """(n_shingles, component_id) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in given}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def joined(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}


def variants(rng, count):
    """Texts near each other: edited, cut, joined and copied, with passages that many share."""
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 8, 30, 60, 200]))) for _ in range(12)]
    out = []
    for _ in range(count):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1, 6])] = rng.choices(vocabulary, k=rng.choice([0, 1, 1]))
            w = w or ["a"]
        text = " ".join(w)
        out.append(text + " " + passage if rng.random() < 0.4 else text)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_join_loses_no_link(spark, monkeypatch, seed):
    if seed:  # a coarse sketch and few entries per bucket change the plan, not the result
        monkeypatch.setattr(ngram_join, "PER_BUCKET", 200)
        monkeypatch.setattr(ngram_join, "MEMBERS", 3)
    if seed == 2:  # hot shingles over several tasks, long lists in parts
        monkeypatch.setattr(ngram_join, "HOT", 4)
        monkeypatch.setattr(ngram_join, "PART", 3)
    rng = random.Random(seed)
    given = list(enumerate(variants(rng, 160)))
    assert joined(docs(spark, given)) == plain_join(given)


def test_exact_round_alone_finds_all(spark, monkeypatch):
    """Without the star round the last one has to find every link itself."""
    given = list(enumerate(variants(random.Random(8), 120)))
    real = ngram_join._stars
    monkeypatch.setattr(ngram_join, "_stars", lambda lists: real(lists).limit(0))
    assert joined(docs(spark, given)) == plain_join(given)


def test_join_odd_rows(spark):
    text = "one two three four five six seven"
    given = [(9, text), (4, text.upper()), (4, text.upper()), (None, text), (5, None), (6, ""), (7, " \n\t "), (8, "one  two"), (3, "ONE two"), (2, "x" * 100000), (1, "a b c d e " * 30000)]
    out = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.join(docs(spark, given)).collect())
    assert out == [(-1, 3, None), (1, 5, 1), (2, 1, 2), (3, 1, 3), (4, 3, 4), (4, 3, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 3), (9, 3, 4)]
    assert joined(docs(spark, [])) == {}


def test_threshold_is_met_exactly(spark):
    # 7 shingles, of which 6 are shared: 6/8 is just a link; 5/9 is none.
    base = [f"t{k}" for k in range(11)]
    one, two = base[:-1] + ["z"], base[:-2] + ["y", "z"]
    given = [(1, " ".join(base)), (2, " ".join(one)), (3, " ".join(two[:9] + ["q", "r"]))]
    assert joined(docs(spark, given)) == plain_join(given)
    assert plain_join(given)[2][1] == 1 and plain_join(given)[3][1] == 3


@hypothesis_given(st.lists(st.integers(0, 300), min_size=1, max_size=60), st.integers(1, 200))
@settings(max_examples=200, deadline=None)
def test_prefix_lengths(counts, n):
    level = ngram_join.choose_level(np.sort(np.array((counts * n)[:n], float)), n)
    tau = ngram_join.least_overlap(n)
    assert 1 <= level <= max(1, min(ngram_join.LEVELS, tau))
    assert 100 * tau >= 75 * n > 100 * (tau - 1)


def test_long_lists_ask_for_more_matches():
    assert ngram_join.choose_level(np.zeros(100), 100) == 1
    assert ngram_join.choose_level(np.full(100, 500.0), 100) > 1


def test_copies_leave_one_document(spark):
    given = docs(spark, [(9, "one two three four five six"), (4, "one two three four five six"), (4, "one two three four five six"), (5, "other"), (None, "x"), (6, None)])
    kept = ngram_join.deduplicate(given)
    assert kept.columns == given.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect() if r.text) == [(-1, "x"), (4, "one two three four five six"), (5, "other")]
    assert any(r.doc_id == 6 for r in kept.collect())


def test_copies_of_repeated_ids(spark):
    a, b = "one two three four five six", "a b c d e f g h i j"
    given = [(1, a), (1, b), (2, a), (3, b + " k"), (3, b + " k"), (3, ""), (3, ""), (4, None), (2, "other text of its own")]
    rows_ = docs(spark, given).withColumnRenamed("k", "first_id").withColumnRenamed("n", "OWN_hash").withColumnRenamed("token", "first_hash")
    kept = ngram_join.deduplicate(rows_)
    assert kept.columns == rows_.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, b), (1, a), (2, "other text of its own"), (3, ""), (4, "")]


def test_posts_are_packed_without_loss():
    rng = np.random.default_rng(0)
    r = np.empty(1000, ngram_join._RECORD)
    r["token"], r["k"] = rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2), rng.integers(-(1 << 62), 1 << 62, 1000)
    r["n"], r["place"] = rng.integers(0, 1 << 31, 1000), rng.integers(0, 1 << 31, 1000)
    assert (ngram_join._unpack(*ngram_join._pack(r, True)) == r).all()
    short = ngram_join._unpack(*ngram_join._pack(r, False))
    assert (short["token"] == r["token"] % np.uint64(1 << 48)).all() and all((short[c] == r[c]).all() for c in ("k", "n", "place"))


# --- SentencePiece ------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=suffix_pieces.vocabulary())


ALPHABET = ["a", "b", "e", "t", "h", " ", "  ", "the", "ing", "\n", "\t", "é", "ñ", "你", "ﬁ", "Å", "▁", "\0", "😀", "1", "22", "..", "’", "aaaa", "<s>", "<0x41>", "\r", "http://"]


@hypothesis_given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_pieces_are_the_librarys(model, texts):
    v = suffix_pieces.load(suffix_pieces.vocabulary())
    coded = suffix_pieces.encode_texts(texts, v)
    assert [array("I", c).tolist() for c in coded] == model.encode(texts)
    assert [suffix_pieces.decode_ids(c, v) for c in coded] == model.decode(model.encode(texts))


def test_edges_are_all_occurrences():
    v = suffix_pieces.load(suffix_pieces.vocabulary())
    text = "▁the▁theta\0banana\0▁aaaa"
    start, end, piece = suffix_pieces.suffix_edges(np.array([ord(x) for x in text], np.uint32), v)
    found = {(int(a), int(b), int(p)) for a, b, p in zip(start, end, piece)}
    assert found == {(a, a + n, v.id[text[a : a + n]]) for a in range(len(text)) for n in range(1, v.longest + 1) if a + n <= len(text) and text[a : a + n] in v.id}


def test_documents_are_coded_whole(spark, model):
    table = spark.read.parquet(TABLE)
    texts = {r.doc_id: r.text for r in table.collect()}
    out = suffix_pieces.round_trip(table).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = model.encode(texts[r.doc_id])
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_coding_odd_rows(spark, model):
    given = docs(spark, [(1, None), (2, ""), (3, "a" * 50000), (3, "a" * 50000), (None, "x y")])
    coded = suffix_pieces.encode(given)
    out = sorted((r.doc_id or -1, list(r.ids)) for r in coded.collect())
    assert out == sorted([(1, []), (2, []), (3, model.encode("a" * 50000)), (3, model.encode("a" * 50000)), (-1, model.encode("x y"))])
    back = sorted((r.doc_id or -1, r.text) for r in suffix_pieces.decode(coded).collect())
    assert back == sorted([(1, ""), (2, ""), (3, "a" * 50000), (3, "a" * 50000), (-1, "x y")])
    assert suffix_pieces.round_trip(docs(spark, [])).collect() == []


# --- packing ------------------------------------------------------------------


def by_hand(given):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(lp_packing.vocabulary()), collections.Counter()
    for i, t in given:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            out[i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def check_packed(rows_, given):
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows_) == by_hand(given)
    sequences = collections.defaultdict(list)
    for r in rows_:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(sequences)


def test_packing_of_the_whole_table(spark):
    table = spark.read.parquet(TABLE)
    given = [(r.doc_id, r.text) for r in table.collect()]
    out = lp_packing.pack(lp_packing.pieces(table)).collect()
    assert check_packed(out, given) <= 1.01 * -(-sum(r.length for r in out) // 4096) + 1


def test_packing_odd_rows(spark):
    given = [(1, None), (2, ""), (3, "word " * 9000), (3, "word " * 9000), (None, "it's Don't <|endoftext|> 'S é"), (4, "a,b. 'x' 12 3.4%—“q” ÀÉ ǅ İi ﬁ"), (5, "\x1cA\x85B　C\xa0d")]
    out = lp_packing.pack(lp_packing.pieces(docs(spark, given))).collect()
    check_packed(out, given)
    assert lp_packing.pack(lp_packing.pieces(docs(spark, []))).collect() == []


ODD = [*"abAB01'.,-<|>é—Kİ \n", "\u0301", "\u212a", "<|endoftext|>", "'re", "n't", "ß"]


@hypothesis_given(st.lists(st.lists(st.sampled_from(ODD), max_size=30).map("".join), min_size=1, max_size=20))
@settings(max_examples=150, deadline=None)
def test_chunks_encode_like_whole_texts(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(lp_packing.vocabulary())
    coded = lp_packing.encode(texts, lp_packing.vocabulary())
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@hypothesis_given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_plans_hold_every_item(histogram):
    size = sorted(histogram)
    held = collections.Counter()
    bins = 0
    for count, n in lp_packing.plan(histogram, 64):
        assert sum(int(c) * s for c, s in zip(count, size)) <= 64
        bins += n
        for c, s in zip(count, size):
            held[s] += int(c) * n
    assert +held == collections.Counter(histogram)
    # first fit decreasing as a yardstick
    room = []
    for s in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        at = next((k for k, r in enumerate(room) if r >= s), None)
        if at is None:
            room.append(64 - s)
        else:
            room[at] -= s
    assert bins <= len(room) * 1.1 + 2


# --- pipeline -----------------------------------------------------------------


def test_pipeline_matches_its_stages_by_hand(spark, tmp_path):
    rng = random.Random(3)
    given = [(k, t) for k, t in enumerate(variants(rng, 60))] + [(100, "123 456"), (101, None), (102, 'the password = "abcdefgh12345678" was here'), (103, "clean words only")]
    full = [(i, t, "en", "s", len(t or "")) for i, t in given]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "secret_scan", "best_fit_packing"]
    kept = [(i, t) for i, t in given if t and re.search(r"[^\W\d_]", t)]
    comps = plain_join(kept)
    kept = [(i, t) for i, t in kept if comps[i][1] == i]
    kept = [(i, t.replace('password = "abcdefgh12345678', secret_scan.MARK) if i == 102 else t) for i, t in kept]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packed(out, kept)
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_of_nothing(spark):
    empty = docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []
    assert language_id.learn(empty)[0] == []


def test_a_task_describes_texts_in_small_slices(monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from odolake.llm import common, ngram_join

    monkeypatch.setattr(common, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    monkeypatch.setattr(ngram_join, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [" ".join(f"w{k}x{j}" for j in range(400)) for k in range(1200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1200)), "h": list(range(1200)), "text": texts})
    tracemalloc.start()
    rows = sum(b.num_rows for b in ngram_join._describe([batch]) if b.column(0).null_count == 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1200
    assert peak < 48 << 20  # twice that with slices of a million characters
