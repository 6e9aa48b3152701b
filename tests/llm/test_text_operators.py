"""Media, BPE, packing, language and language-model scoring."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from chronoframe.llm import bpe, brown, langid, media, packing
from chronoframe.llm.queries import tokenizer_file
from tests.llm.helpers import DOCS, EDGES, clashing, documents

SF = "/root/testdata/sf0.001"
BYTES, WORDS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")


# ---- media


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_carving_finds_media_inside_others_and_corrects_types():
    import gzip

    inner, wav = png(), media.store(media.pad(b"abc"))
    data = b"junk BM GIF89a" + inner + b"RIFF????WAVE" + wav + gzip.compress(b"hello" * 1000) + b"tail"
    kinds = [(k, data[s:e]) for s, e, k in media.carve(data)]
    assert ("image/png", inner) in kinds and ("audio/wav", wav) in kinds and [k for k, _ in kinds].count("application/gzip") == 1 and len(kinds) == 3
    assert media.sniff(inner, "image/jpeg") == {"type": "image/png", "corrected": True, "embedded": []}
    assert media.sniff(inner[:-5], "image/png")["type"] == media.UNKNOWN
    assert media.sniff(None, None)["type"] is None and media.sniff(b"", None)["type"] == media.UNKNOWN


def test_gif_bmp_jpeg_zip_pdf_ogg():
    import io
    import zipfile

    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    bmp = struct.pack("<2sIHHI", b"BM", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xc0\0\x0b\x08\0\x01\0\x01\x01\x01\x11\0\xff\xda\0\x08\x01\x01\0\0?\0\xff\0\x12\xff\xd9"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    pdf = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"
    for data, kind in ((gif, "image/gif"), (bmp, "image/bmp"), (jpeg, "image/jpeg"), (z.getvalue(), "application/zip"), (pdf, "application/pdf")):
        assert media.carve(b"xx" + data + b"yy")[0] == (2, 2 + len(data), kind)


def test_sniff_column(spark):
    df = spark.createDataFrame([(1, bytearray(png()), "image/gif"), (2, None, "image/gif"), (3, bytearray(b"x" + png()), None)], "id int, content binary, declared string")
    got = {r["id"]: r["media"] for r in media.sniff_column(df, "content", "declared").collect()}
    assert got[1]["type"] == "image/png" and got[1]["corrected"] and got[2]["type"] is None
    assert bytes(got[3]["embedded"][0]["bytes"]) == png()


def test_text_media(spark):
    got = media.text_media(clashing(spark, "n_bytes", "feature")).collect()
    assert len(got) == len(EDGES)
    want = Counter()
    for doc, text, *_ in EDGES:
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        want[doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(payload) + 44] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    assert media.text_media(documents(spark, []).limit(0)).count() == 0


# ---- BPE


def test_round_trip_equals_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    t.no_truncation()
    t.no_padding()
    rows = bpe.round_trip(clashing(spark, "n_tokens"), BYTES).collect()
    want = Counter()
    for doc, text, *_ in EDGES:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want[doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in rows) == want


@pytest.mark.parametrize("text", ["aaaaaaaaaaaaaaaa", "  two  spaces \n\n x", "ab cd", "x\x1cy\x85z", "🙂🙂 é́", "I'll we've 'S", "½ ² Ⅷ ª º µ", "​　 ", "<|endoftext|><|endoftext|> a"])
def test_encoders_equal_library(text):
    from tokenizers import Tokenizer

    for path, kind in ((BYTES, bpe.Encoder), (WORDS, packing.WordIds)):
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        with open(path, "rb") as f:
            own = bpe.load(f.read(), kind)
        ids = t.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


# ---- packing


def test_open_bins_take_the_fullest_that_fits_and_close_the_fullest():
    b = packing.OpenBins(10, 2)
    assert b.put(6) == (0, 0) and b.put(7) == (1, 0)
    assert b.put(3) == (1, 7)  # three places free in bin 1, four in bin 0
    assert b.put(4) == (0, 6)
    assert b.put(5) == (2, 0) and b.put(6) == (3, 0)
    assert b.put(9) == (4, 0)  # the fullest of two open bins, bin 3 with four free, goes
    assert b.put(5) == (2, 5) and b.put(4) == (5, 0)


def test_packing_of_edges(spark):
    rows = packing.pack(clashing(spark, "piece", "offset"), WORDS).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r[0] for r in EDGES)
    assert sum(r["length"] for r in rows if r["doc_id"] == 7) == 20001
    assert packing.pack(documents(spark, []).limit(0), WORDS).count() == 0


# ---- language


def test_language_accuracy_on_rows_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in langid.identify(docs).collect() if r["held_out"]]
    assert held and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_language_edges(spark):
    rows = langid.identify(clashing(spark, "score", "held_out")).collect()
    assert len(rows) == len(EDGES)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[5]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert langid.identify(documents(spark, []).limit(0)).count() == 0


def test_backoff_uses_shorter_grams_only_where_longer_ones_are_unknown():
    m = langid.Model([("a", 0, "known", 5), ("b", 0, "other", 5), ("a", 2, "kn", 5), ("b", 2, "ot", 5), ("a", 1, "x", 1), ("b", 1, "y", 1)])
    assert m.word("known")[0] > m.word("known")[1]
    assert m.word("knx")[0] > m.word("knx")[1] and m.word("oty")[1] > m.word("oty")[0]
    assert m.predict("known knx")[0] == "a" and m.predict("123") == ("und", 0.0)


def test_predictions_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    model = langid.fit(docs)
    seen: dict = {}
    for lang, text in {(r["lang"], r["text"]) for r in rows if r["lang"] is not None and r["text"] is not None}:
        for w in langid.words(text):
            for n, item in [(0, w), *((n, g) for n in langid.GRAMS for g in langid.grams(w, n))]:
                seen.setdefault((lang, n), Counter())[item] += 1
    langs = sorted({k[0] for k in seen})
    known = {n: set().union(*(seen.get((lang, n), ()) for lang in langs)) for n in (0, *langid.GRAMS)}
    room = {key: sum(c.values()) + len(c) + 1 for key, c in seen.items()}
    least = {n: max(r for (_, k), r in room.items() if k == n) for n in known}

    def log(lang, n, item):
        return math.log((seen[lang, n][item] + 1) / room[lang, n]) if seen[lang, n][item] else -math.log(least[n])

    def word(w, lang):
        if w in known[0]:
            return log(lang, 0, w)
        s, at, total, steps = f" {w} ", 0, 0.0, 0
        while at < len(s):
            n = next((n for n in langid.GRAMS if s[at : at + n] in known[n] and at + n <= len(s)), None)
            total += 0 if n is None else log(lang, n, s[at : at + n])
            at += n or 1
            steps += 1
        return total / steps

    assert model.langs == langs
    for text in ["Anblewh zzqq 中文 x½y", *(r["text"][:400] + " unseenword qxqx" for r in rows[:12] if r["text"])]:
        total = {lang: sum(word(w, lang) for w in langid.words(text)) for lang in langs}
        best = max(langs, key=lambda x: total[x])
        got = model.predict(text)
        assert got[0] == best and got[1] == pytest.approx(1 / sum(math.exp(x - total[best]) for x in total.values()), rel=1e-6)
    assert model.predict("½ ² Ⅷ 12")[0] == "und"


def test_a_bounded_sample_keeps_every_language(spark):
    rows = [(i, f"wort{i} und satz{i} " * 30, "de", "s", 1) for i in range(300)] + [(400, "una parola sola", "it", "s", 1)] * 50
    model = langid.fit(spark.createDataFrame(rows, DOCS), 4000)
    assert model.langs == ["de", "it"] and 0 < sum(w.startswith("wort") for w in model.index[0]) < 300
    assert model.predict("parola")[0] == "it"


# ---- scoring


def test_base_scores_equal_brute_force(spark):
    docs = clashing(spark, "score", "n_tokens")
    got = sorted((tuple(r) for r in brown.score(docs).collect()), key=str)
    tokens = [(r[0], (r[1] or "").encode().lower().split()) for r in EDGES]
    training = [w for d, w in tokens if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    c = Counter(x for w in training for x in w)
    n, v = sum(c.values()) + len(training), len(c) + 1
    assert len(got) == len(EDGES)
    for r in got:
        own = next(w for d, w in tokens if d == r[0])
        assert r[2] == len(own) + 1 and r[3] == sum(c[x] > 0 for x in own) + 1 and r[4] == n
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in own) + math.log10((len(training) + 1) / (n + v + 1))
        assert r[5] == pytest.approx(base, rel=1e-9) and math.isfinite(r[6]) and r[6] < 0


def test_scores_equal_brute_force(spark, monkeypatch):
    """The model's classes are taken from it; all counts and sums are made again from the texts."""
    monkeypatch.setattr(brown, "KNOWN", 2000)
    monkeypatch.setattr(brown, "KNOWN_A_SEED", 16)
    models, fit = [], brown.fit
    monkeypatch.setattr(brown, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in brown.score(docs).collect()}
    (m,), words = models, {d: brown.tokens(t) for d, t in rows.items()}
    held = {d for d in rows if zlib.crc32(str(d).encode()) % 7 == 2}
    c = Counter(w for d in rows if d not in held for w in words[d])
    known = sorted((w for w in c if len(w) <= 256), key=lambda w: (-c[w], w))[: len(m.classes) - 2]
    assert 1000 < len(known) < len(c) and len(set(m.classes.tolist())) == len(m.steps)
    cls = {w: int(m.classes[i]) for i, w in enumerate(known)}
    end, open_ = len(m.steps) - 2, len(m.steps) - 1
    chain = lambda ws: [end, *(cls.get(w, open_) for w in ws), end]
    steps = Counter(x for d in rows if d not in held for x in zip(chain(words[d]), chain(words[d])[1:]))
    row, mass, size = Counter(), Counter(), Counter()
    for (a, _), n in steps.items():
        row[a] += n
    for w, n in c.items():
        mass[cls.get(w, open_)] += n
        size[cls.get(w, open_)] += 1

    def emitted(w):
        k = cls.get(w, open_)
        return (c[w] + 1) / (mass[k] + size[k] + 1) if k == open_ else (c[w] + 0.1) / (mass[k] + 0.1 * size[k])

    k = len(m.steps)
    for d, ws in words.items():
        path = chain(ws)
        want = sum(math.log10((steps[a, b] + 0.1) / (row[a] + 0.1 * k)) for a, b in zip(path, path[1:])) + sum(math.log10(emitted(w)) for w in ws)
        assert got[d]["score"] == pytest.approx(want) and got[d]["held_out"] == (d in held)
        assert got[d]["n_known"] == 1 + sum(c[w] > 0 for w in ws)
    assert sum(got[d]["score"] for d in held) > sum(got[d]["base_score"] for d in held)  # classes predict better than single words
    assert np.allclose((10.0**m.step).sum(axis=1), 1)
    for x in set(m.classes[:-2].tolist()) - {open_}:
        assert sum(emitted(w) for w in known if cls[w] == x) == pytest.approx(1)


def test_words_beside_seeds_go_to_the_class_that_gains_most():
    r = np.random.default_rng(4)
    table = r.integers(0, 40, (5, 5)).astype(float)
    word, side, cls, count = [], [], [], []
    for w in range(30):
        for s in (0, 1):
            for c in range(5):
                if (n := r.integers(0, 6)) > 2:
                    for x, y in zip((word, side, cls, count), (w, s, c, n)):
                        x.append(y)
    word, side, cls, count = map(np.array, (word, side, cls, count))
    got = dict(zip(*(x.tolist() for x in brown.best_classes(word, side, cls, count.astype(float), table))))

    def likelihood(t):
        f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))

    for w in set(word.tolist()):
        values = []
        for to in range(4):
            t = table.copy()
            for s, c, n in zip(side[word == w], cls[word == w], count[word == w]):
                t[(to, c) if s == 0 else (c, to)] += n
            values.append(likelihood(t))
        assert values[got[w]] == pytest.approx(max(values))


def test_words_beside_no_seed_get_a_class_too(spark, monkeypatch):
    for name, x in (("SEEDS", 4), ("KNOWN_A_SEED", 2), ("SEEDS_A_CLASS", 2)):
        monkeypatch.setattr(brown, name, x)
    models, fit = [], brown.fit
    monkeypatch.setattr(brown, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    texts = ["a b c d a c b d a d b c"] * 20 + ["a m1 p q r m2 b"] * 5
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    assert brown.score(docs).count() == 25
    assert len(models[0].classes) == 11 and (models[0].classes[:-2] < len(models[0].steps) - 1).all()


def test_exchange_raises_the_likelihood():
    r = np.random.default_rng(1)
    pairs = np.zeros((41, 41), np.int64)
    side = np.arange(40) % 2
    for _ in range(4000):
        a = r.integers(40)
        b = r.choice(np.flatnonzero(side != side[a]))
        pairs[a, b] += 1
    own = brown.exchange(pairs, 2)
    assert len(set(own[:40][side == 0])) == 1 and len(set(own[:40][side == 1])) == 1 and own[40] == 2


def test_each_round_of_exchange_moves_up():
    pairs = np.random.default_rng(2).integers(0, 9, (13, 13))
    pairs[pairs < 6] = 0

    def likelihood(own):
        n = np.zeros((4, 4))
        np.add.at(n, (own[:, None], own[None]), pairs)
        f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return f(n) - f(n.sum(axis=0)) - f(n.sum(axis=1))

    own = brown.exchange(pairs, 3)
    best = likelihood(own)
    for u in range(12):
        for c in range(3):
            other = own.copy()
            other[u] = c
            assert likelihood(other) <= best + 1e-6


def test_nothing_to_learn_from(spark):
    got = brown.score(spark.createDataFrame([], DOCS)).count()
    assert got == 0
    rows = [r for r in EDGES if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2] or [(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "a b", "en", "s", 3)]
    for r in brown.score(spark.createDataFrame(rows, DOCS)).collect():
        assert r["held_out"] and r["n_known"] == r["train_tokens"] == 0 and math.isfinite(r["score"])


def test_ids_with_spaces(spark):
    df = spark.createDataFrame([("a b 1", "x y"), ("", "z"), (None, "x")], "doc_id string, text string")
    assert Counter(r["doc_id"] for r in brown.score(df).collect()) == Counter(["a b 1", "", None])
