"""Operators on texts: language ID, secrets, personal data, chat formatting, language model."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import regex

from odolake.llm import backoff_lm, chat_format, disclosure, language_id, secret_scan
from odolake.llm.common import word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id int, spans string"
TABLE = "/root/testdata/sf0.001/documents.parquet"


def docs(spark, rows):
    """Documents with some extra columns whose names clash with those the operators use."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or ""), 0.5, 1, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- word hashes --------------------------------------------------------------


def test_word_hashes_follow_the_words():
    texts = ["", "  ", "A b\x0bC\x1cd", "b a", "ÄB äb", "x" * 5000 + " y"]
    h, at = word_hashes(texts)
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)) for t in texts]
    assert [b - a for a, b in zip(at[:-1], at[1:])] == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


# --- language identification --------------------------------------------------


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet(TABLE)
    true = {r.doc_id: r.lang for r in table.collect()}
    out = language_id.identify(table).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == true[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_language_matches_a_plain_bayes(spark):
    given = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")] * 8)]
    langs, table = language_id.learn(docs(spark, given))
    assert langs == ["de", "en", "fr"]
    counts, totals = collections.Counter(), collections.Counter()
    for _, t, lang in given:
        g, _ = language_id.ngram_buckets([t])
        for b in g[g >= 0].tolist():
            counts[lang, b] += 1
            totals[lang] += 1
    for k, lang in enumerate(langs):
        for b in {b for _, b in counts}:
            p = (counts[lang, b] + language_id.ALPHA) / (totals[lang] + language_id.ALPHA * language_id.BUCKETS)
            assert table[b, k] == pytest.approx(math.log(p))
    # The scores of a slice are those of its texts one by one.
    texts = ["", "x", "der hund", "", "the dog " * 50]
    together = language_id.scores(texts, table)
    for k, t in enumerate(texts):
        assert together[k] == pytest.approx(language_id.scores([t], table)[0])


def test_language_odd_rows(spark):
    given = [(1, None), (2, ""), (3, "12 !? _"), (4, "the cat", "en"), (4, "the cat", "en"), (None, "the cat", "en"), (6, "le chat", None), (7, "the dog", "en"), (8, "² ½ ① Ⅻ _"), (9, "日")]
    out = language_id.identify(docs(spark, given)).collect()
    assert len(out) == 10
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 3, 8)} == {"und"}
    assert {r.lang_pred for r in out if r.doc_id == 9} == {"en"}
    assert all(r.held_out is False for r in out if r.doc_id is None)
    assert language_id.identify(docs(spark, [])).collect() == []
    alone = language_id.identify(docs(spark, [(6, "le chat", None)])).collect()
    assert [(r.lang_pred, r.score) for r in alone] == [("und", 0.0)]


def test_language_stage_keeps_clean_documents(spark):
    given = docs(spark, [(1, None), (3, "123"), *((k, "the cat and the dog", "en") for k in range(4, 20)), (20, "the cat", None)])
    kept = language_id.keep_known(given)
    assert kept.columns == given.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(4, 21))


def test_language_stage_drops_what_is_in_no_known_language(spark):
    table = spark.read.parquet(TABLE).select("doc_id", "text", "lang")
    strange = ["Это предложение написано на русском языке", "これは日本語の文章です。", "xq zzkj wvvq pqxz", "!!!@@@###$$$ a %%%^^^&&&***"]
    more = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(strange)], "doc_id long, text string, lang string")
    kept = [r.doc_id for r in language_id.keep_known(table.unionByName(more)).select("doc_id").collect()]
    assert min(kept) >= 0
    known = table.where("lang is not null and text rlike '[a-zA-Z]'").count()
    assert len(kept) >= 0.99 * known


# --- secrets ------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)


def plain_base(text):
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(s))


def test_secret_base_spans(spark):
    rng = random.Random(5)
    parts = ["password", "PassWD", "token", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "a1b2c3d4e5f6", "AKIA", "AKIAQ7W8E9R0T1Y2U3", "deadbeef", "0123456789abcdef", "é", "ſecret", "😀", "\n", "Zz9+/", ".", "-"]
    given = [(k, "".join(rng.choices(parts, k=rng.randint(0, 25)))) for k in range(400)] + [(999, None)]
    out = rows(secret_scan.digest(secret_scan.scan(docs(spark, given))))
    for k, text in given:
        base = plain_base(text or "")
        assert out[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [out[k].n_assign, out[k].n_access, out[k].n_hex] == [base.count(x + ":") for x in ("assign", "access", "hex")]
        assert ",".join(s for s in out[k].spans.split(",") if not s.startswith("random")) == base


def test_random_strings_are_found_and_words_are_not(spark):
    given = [
        (1, "key qX9vT2mK7wZ4pL8nB3jR6yC1 here"),
        (2, "internationalization_of_characteristics and getElementsByClassName2"),
        (3, "id 550e8400-e29b-41d4-a716-446655440000 seen"),
        (4, "MD5 D41D8CD98F00B204E9800998ECF8427E ok"),
        (5, "11111111111111111111111111"),
    ]
    out = rows(secret_scan.digest(secret_scan.scan(docs(spark, given))))
    assert out[1].spans == "random:4:28"
    assert all("random" not in out[k].spans for k in (2, 3, 4, 5))


def plain_random(text, encoding):
    """Spans of the method, run by run."""
    base = [tuple(map(int, x.split(":")[1:])) for x in plain_base(text).split(",") if x]
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        run = m[0]
        tail = re.sub(r"[0-9]{1,4}$", "", run)
        named = len([x for x in re.split(r"[_/-]+", tail) if x]) > 1 and all(re.fullmatch("[A-Za-z]{1,14}", x) for x in re.split(r"[_/-]+", tail) if x)
        digest = re.fullmatch(r"(?i)[0-9a-f]+", run) and len(run) in (32, 40, 56, 64, 96, 128) or re.fullmatch(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", run)
        if len(run) < 20 or named or digest or not re.search("[A-Za-z]", run) or any(a < m.end() and m.start() < b for a, b in base):
            continue
        if len(run) < 2.1 * len(encoding.encode_ordinary(run)):
            out.append(f"random:{m.start()}:{m.end()}")
    return out


def test_random_spans_of_whole_tables_and_long_texts(spark):
    rng = random.Random(3)
    encoding = secret_scan._encoding(*secret_scan.vocabulary())
    lower, alnum = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    strings = {name: ["".join(rng.choices(chars, k=32)) for _ in range(300)] for name, chars in (("lower", lower), ("alnum", alnum))}
    table = [(r.doc_id, r.text) for r in spark.read.parquet(TABLE.replace("0.001", "0.01")).collect()]
    given = table + [(10_000 + k, f"words before {x} and after") for k, x in enumerate(strings["lower"] + strings["alnum"])]
    given += [(20_000, " some_long_identifier_of_words/in-parts2 " * 20_000 + strings["alnum"][0]), (20_001, strings["lower"][0]), (20_001, strings["lower"][0]), (20_002, "12345678901234567890123 SOME_LONG_CONSTANT_NAME_HERE")]
    out = secret_scan.digest(secret_scan.scan(docs(spark, given))).collect()
    want = {(i, ",".join(sorted([*(x for x in plain_base(t or "").split(",") if x), *plain_random(t or "", encoding)], key=lambda x: int(x.split(":")[1])))) for i, t in given}
    assert {(r.doc_id, r.spans) for r in out} == want and len(out) == len(given)
    found = sum("random" in r.spans for r in out if 10_000 <= r.doc_id < 10_600)
    assert found >= 0.97 * 600 and not any("random" in r.spans for r in out if r.doc_id < 10_000)


def test_redaction(spark):
    given = docs(spark, [(1, "é token = abcdef0123456789 z"), (2, "clean"), (3, None), (4, "")])
    out = rows(secret_scan.redact(given))
    assert secret_scan.redact(given).columns == given.columns
    assert out[1].text == "é [SECRET] z" and out[1].n_chars == 12
    assert (out[2].text, out[3].text, out[4].text) == ("clean", None, "")
    assert secret_scan.scan(docs(spark, [])).collect() == []


# --- personal data ------------------------------------------------------------


def digits(m):
    return re.sub("[^0-9]", "", m)


def luhn(x):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(x))) % 10 == 0


PII = [
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(digits(m)) <= 15),
]


def plain_pii(text):
    s = sorted((m.start(), n, m.end()) for n, (p, ok) in enumerate(PII) for m in p.finditer(text) if ok(m[0]))
    return ",".join(f"{disclosure.KINDS[n]}:{a}:{b}" for a, n, b in s)


def test_personal_data_base_spans(spark):
    rng = random.Random(11)
    parts = ["a", "b.c", "@", "x@y.z", "_d@e.f", ".", "..", "-", " ", "é", "😀", "1", "25", "256", "0", "10.0.0.1", "4111111111111111", "4111 1111 1111 1111", "+1", "+1 (555) 010-9999", "+", "(", ")", "\n", "%"]
    given = [(k, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for k in range(500)]
    given += [(900, None), (901, ""), (902, "a" * 60000), (903, "1 " * 20000 + "z"), (904, "9" * 40000), (905, "1." * 20000), (906, "a@b" + ".c" * 15000), (907, "+1" + " (" * 20000)]
    out = rows(disclosure.digest(disclosure.find(docs(spark, given))))
    assert len(out) == len(given)
    for k, text in given:
        base = plain_pii(text or "")
        assert out[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (k, text[:80] if text else text)
        assert [out[k].n_email, out[k].n_ip, out[k].n_card, out[k].n_phone] == [base.count(x + ":") for x in disclosure.KINDS]


def test_revealing_terms(spark):
    # "zorblax" stands in no other document than those that name the person; "hello" stands in most.
    given = [(k, f"hello zorblax number {'abcdefg'[k % 7]} write to eve@corp.example now\nhello again") for k in range(6)]
    given += [(100 + k, f"hello people number write now line {k}") for k in range(60)]
    frame = docs(spark, given)
    out = rows(disclosure.digest(disclosure.find(frame)))
    texts = dict(given)
    for k in range(6):
        terms = [s.split(":") for s in out[k].spans.split(",") if not s.startswith("email")]
        assert [texts[k][int(a) : int(b)] for _, a, b in terms] == ["zorblax"]
    assert all(out[100 + k].spans == "" for k in range(60))
    clean = rows(disclosure.sanitise(frame))
    assert clean[0].text.startswith("hello ") and "zorblax" not in clean[0].text and "[EMAIL]" in clean[0].text
    assert clean[100].text == texts[100]


def test_copies_of_one_line_reveal_nothing(spark):
    given = [(k, "meet quixotic at eve@corp.example") for k in range(5)] + [(50 + k, f"other words {k}") for k in range(20)]
    out = rows(disclosure.digest(disclosure.find(docs(spark, given))))
    assert out[0].spans == "email:17:33"
    assert disclosure.find(docs(spark, [])).collect() == []


def test_entities_of_one_document_have_terms(spark):
    # One distinct line, in copies or alone: in a corpus of this size one sighting is enough.
    given = [(k, "meet quixotic people at eve@corp.example") for k in range(5)] + [(9, "call zorblax people: +1 (555) 010-9999")]
    given += [(50 + k, f"meet call people {k}") for k in range(200)]
    out = rows(disclosure.digest(disclosure.find(docs(spark, given))))
    assert {out[k].spans for k in range(5)} == {"term:5:13,email:24:40"}
    assert out[9].spans == "term:5:12,phone:21:38"


def test_the_whole_document_is_context(spark):
    # On the line below, elsewhere, of few letters, of another script; flagged in every document of the entity.
    given = [(k, f"people {k}\n+1 (555) 010-9999\nof Li zorblax\n\n李明 says") for k in range(4)]
    given += [(50 + k, f"people of says {k}") for k in range(200)]
    out = rows(disclosure.find(docs(spark, given), context="document"))
    for k in range(4):
        assert [given[k][1][t.start : t.end] for t in out[k].terms] == ["Li", "zorblax", "李明"]
    assert all(not out[50 + k].terms for k in range(200))
    clean = rows(disclosure.sanitise(docs(spark, given), context="document"))
    assert not any(w in clean[0].text for w in ("Li", "zorblax", "李明", "555"))


def test_terms_are_found_on_the_whole_table(spark):
    out = disclosure.find(spark.read.parquet(TABLE)).where("size(terms) > 0")
    assert out.count() > 0


def plain_terms(given):
    """{text: [(start, end, disclosure)]} by the formula, with the document as context."""
    texts = {t or "" for _, t in given}
    spans = {t: sorted((m.start(), n, m.end(), m[0]) for n, (p, ok) in enumerate(PII) for m in p.finditer(t) if ok(m[0])) for t in texts}
    entities = {t: {f"{disclosure.KINDS[n]}:{v.lower()}" for _, n, _, v in s} for t, s in spans.items()}
    words = {t: set(regex.findall(r"\p{L}+", t.lower())) for t in texts}
    context = {t: set(regex.findall(r"\p{L}+", PII[0][0].sub(" ", t).lower())) for t in texts if entities[t]}
    df_t = collections.Counter(w for t in texts for w in words[t])
    df_e = collections.Counter(e for t in texts for e in entities[t])
    co = collections.Counter((e, w) for t in context for e in entities[t] for w in context[t])
    best = collections.defaultdict(dict)
    for t in context:
        for e in entities[t]:
            if df_e[e] < len(texts):
                for w in context[t]:
                    v = math.log2(co[e, w] * len(texts) / (df_e[e] * (df_t[w] + disclosure.SMOOTH))) / math.log2(len(texts) / df_e[e])
                    best[t][w] = max(v, best[t].get(w, -9))
    out = {}
    for t in context:
        places = [(m.start(), m.end(), best[t].get(m[0].lower(), -9)) for m in regex.finditer(r"\p{L}+", t)]
        out[t] = [(a, b, v) for a, b, v in places if v >= disclosure.GENERALISE and not any(s < b and a < e for s, _, e, _ in spans[t])]
    return out


@pytest.mark.parametrize("few", [64, 0])
def test_terms_of_whole_tables_are_those_of_the_formula(spark, monkeypatch, few):
    monkeypatch.setattr(disclosure, "FEW", few)
    monkeypatch.setattr(disclosure, "BLOCK", 5)
    given = [(r.doc_id, r.text) for r in spark.read.parquet(TABLE).collect()]
    many = " ".join(f"name{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} user{k}@many.example" for k in range(2000))
    given += [(9001, many), (9002, many), (9002, many), (9003, "see user7@many.example, quirkname and zanzibar"), (9004, None), (9005, "")]
    given += [(9100 + k, "the same copy of quartzite for ann@copies.example") for k in range(40)]
    want = plain_terms(given)
    out = disclosure.find(docs(spark, given), context="document").collect()
    assert len(out) == len(given)
    texts = {i: t or "" for i, t in given}
    for r in out:
        found, terms = [(t.start, t.end, t.disclosure) for t in r.terms], want.get(texts[r.doc_id], [])
        assert [f[:2] for f in found] == [t[:2] for t in terms], r.doc_id
        assert all(abs(f[2] - t[2]) < 1e-9 for f, t in zip(found, terms))
    assert len(want[many]) > 1000 and sum(map(len, want.values())) > len(want[many])
    assert disclosure.find(docs(spark, []), context="document").collect() == []


# --- chat formatting ----------------------------------------------------------


def turns(spark, given):
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string, place int")
    return df.withColumn("parts", chat_format.text_part(df["text"]))


def test_chat_round_trip(spark):
    rng = random.Random(2)
    parts = ["<", ">", "\\", "<s>", "</s>", "\n", "[INST]", "<\\", "é😀", "ok ", "<image:1>", "n", "|"]
    given = [(c, t, rng.choice(["user", "assistant", "a<b\n\\c", None]), rng.choice([None, "".join(rng.choices(parts, k=rng.randint(0, 9)))]), 0) for c in range(60) for t in range(rng.randint(1, 6))]
    done = chat_format.format_chats(turns(spark, given))
    out = rows(chat_format.digest(done), "conv_id")
    full = rows(done, "conv_id")
    for c in range(60):
        mine = [(r or "", t or "") for cc, _, r, t, _ in given if cc == c]
        loss = "".join(t for r, t in mine if r == "assistant")
        assert out[c].n_turns == len(mine)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert out[c].formatted_chars == len(full[c].formatted)
        assert full[c].formatted.count("<s>") == len(mine)


def test_chat_parts(spark):
    kind = "array<struct<type:string,text:string,ref:string,units:bigint>>"
    given = [
        (1, 0, "user", [("text", "see <image:1> ", None, None), ("image", None, "a.png", 4), ("audio", None, "b.wav", 10), ("text", "bye", None, None)]),
        (1, 1, "assistant", [("document", None, "c.pdf", None), ("text", "done", None, None)]),
        (2, 0, "user", None),
        (None, 0, "user", [("text", "x", None, None)]),
    ]
    out = rows(chat_format.format_chats(spark.createDataFrame(given, f"conv_id long, turn long, role string, parts {kind}")), "conv_id")
    assert out[1].formatted == "<s>user\nsee <\\image:1> <image:1><audio:2>bye</s><s>assistant\n<document:1>done</s>"
    assert [tuple(a) for a in out[1].attachments] == [(0, 1, "image", "a.png", 1024), (0, 2, "audio", "b.wav", 250), (1, 1, "document", "c.pdf", 1024)]
    assert out[2].formatted == "<s>user\n</s>" and out[None].formatted == "<s>user\nx</s>"
    empty = spark.createDataFrame([], f"conv_id long, turn long, role string, parts {kind}")
    assert chat_format.format_chats(empty).collect() == []


# --- language model -----------------------------------------------------------


def plain_scores(given):
    """The model by its definition, over dictionaries."""
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tok = [(k, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [0]) for k, t in given]
    train = [t for k, t in tok if k is not None and zlib.crc32(str(k).encode()) % 5 != 1]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    follow = collections.Counter((s, w) for t in train for i, w in enumerate(t) for s in ((["<", *t][i],), tuple(["<", *t][i - 1 : i + 1]) if i else None) if s)
    seen = collections.Counter()
    for (s, _), x in follow.items():
        seen[s] += x

    def p(w, s):
        if not s:
            return (c[w] + 0.5) / (n + 0.5 * (v + 1))
        k = backoff_lm.FAILURE[len(s) - 1]
        gamma = k / (k + math.sqrt(seen[s]))
        return (1 - gamma) * follow[s, w] / max(1, seen[s]) + gamma * p(w, s[1:])

    out = []
    for k, t in tok:
        score = sum(math.log10(p(w, tuple(["<", *t][max(0, i - 1) : i + 1]))) for i, w in enumerate(t))
        out.append((k, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p(w, ())) for w in t), score))
    return out


@pytest.mark.parametrize("sizes", [(1 << 23, 1 << 24), (300, 1000), (1, 7)])
def test_language_model_matches_its_definition(spark, monkeypatch, sizes):
    monkeypatch.setattr(backoff_lm, "BLOCK_CHARS", sizes[0])
    monkeypatch.setattr(backoff_lm, "CHARS_PER_BUCKET", sizes[1])
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(80)]
    given = [(k, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for k in range(80)]
    given += [(None, "w1 W2 zzz"), (500, None), (501, ""), (3, given[3][1]), (502, "w1 " * 3000)]
    out = sorted(backoff_lm.score(docs(spark, given)).collect(), key=lambda r: (str(r.doc_id), r.score))
    want = sorted(plain_scores(given), key=lambda r: (str(r[0]), r[5]))
    assert len(out) == len(want)
    for r, w in zip(out, want):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert (r.base_score, r.score) == (pytest.approx(w[4], rel=1e-9), pytest.approx(w[5], rel=1e-9))


def test_language_model_on_a_whole_table(spark):
    table = spark.read.parquet(TABLE)
    given = [(r.doc_id, r.text) for r in table.collect()]
    want = {w[0]: w for w in plain_scores(given)}
    out = rows(backoff_lm.score(table))
    assert len(out) == len(given)
    for k, r in out.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[k][1:4]
        assert (r.base_score, r.score) == (pytest.approx(want[k][4], rel=1e-9), pytest.approx(want[k][5], rel=1e-9))
    held = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # histories tell something about texts not learned from


def test_language_model_probabilities_add_up():
    given = ["a b a c a b d"] * 10 + ["a a b", "d c b a"]
    h, at = backoff_lm.tokens(given)
    counts = []
    for keys, ends in backoff_lm.grams(h, at):
        _, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
        count = np.zeros(len(h), np.int64)
        count[ends] = n[inverse]
        counts.append(count)
    types = len(np.unique(h))
    m = backoff_lm.Automaton(len(h), types, at, counts)
    words, where = np.unique(h, return_index=True)
    new = 0.5 / (m.total + 0.5 * (types + 1))  # all words not seen
    root = np.r_[m.root()[where], new]
    assert root.sum() == pytest.approx(1)
    before = np.r_[backoff_lm.BEGIN, h[:-1]]
    before[at[:-1]] = backoff_lm.BEGIN
    for s in np.unique(before):
        mine = before == s
        arcs = np.r_[[(h[mine] == w).sum() for w in words], 0]
        assert m.before1[mine].tolist() == [mine.sum()] * mine.sum()
        assert backoff_lm.Automaton.step(backoff_lm.FAILURE[0], np.full(len(arcs), mine.sum()), arcs, root).sum() == pytest.approx(1)


def test_language_model_without_training(spark):
    assert backoff_lm.score(docs(spark, [])).collect() == []
    r = backoff_lm.score(docs(spark, [(None, "x y")])).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
