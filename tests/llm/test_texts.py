"""Language identification, spelling variants and fill-in-middle against plain versions of what they compute."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from namelattice.llm import fill_middle, language_id, variants

#: Columns whose names clash with those that operators use.
DOCS = "doc_id long, text string, lang string, i string, t string, k long, n long, word string, form string, l int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", "y", 1, 2, "z", "w", 3) for i, t, g in rows], DOCS).repartition(3)


# --- spelling variants -------------------------------------------------------------------------------------------------


def plain_counts(rows):
    found = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(3)
    letters = "abcéÿ"
    words = ["".join(rng.choices(letters, k=rng.randint(6, 9))) for _ in range(250)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aabaaaa", "aaabaaaa", "abababa", "bababab", "z" * 3000, "z" * 2999 + "y", "z" * 1500 + "z" * 1501]
    typo = words[0]
    for _ in range(4):  # a chain of ever rarer spellings
        at = rng.randrange(len(typo))
        typo = typo[:at] + "x" + typo[at:]
        words.append(typo)
    weights = [12_000, *[rng.choice([1, 2, 3, 30, 400]) for _ in words[1:]]]
    weights[-4:] = [1200, 120, 12, 2]
    bag = [w for w, c in zip(words, weights) for _ in range(min(c, 12_000))]
    rng.shuffle(bag)
    rows = [(i, " ".join(w.capitalize() if rng.random() < 0.1 else w for w in bag[i::60]) + f" x{i}×÷ d'étéĀĀ", "en") for i in range(60)]
    return rows + [(None, "Without an id, without", None), (90, None, "en"), (91, "", "en"), (92, " \n ", "en"), (93, "twiceover twiceover", "de"), (93, "twiceover twiceover", "de")]


@pytest.mark.parametrize("crowded", [variants.CROWDED, 10])
def test_spelling_variants(spark, spelled, crowded):
    expected = plain_variants(plain_counts(spelled))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(frame(spark, spelled), crowded=crowded).collect()}
    assert got == expected
    assert any(form is not None and root != form for form, root, *_ in got.values())


def test_variants_of_an_empty_table(spark):
    assert variants.spelling_variants(frame(spark, [])).count() == 0


def test_light_edges_are_few(spark):
    rng = random.Random(8)
    words = {"".join(rng.choices("abcd", k=rng.randint(7, 12))) for _ in range(1000)}
    light = variants.light_edges(spark.createDataFrame([(w, 2) for w in words], "word string, n long"))
    most = light.groupBy("word").count().agg(F.max("count")).head()[0]
    assert most <= math.log2(len(words))


def test_crc32_of_many_strings():
    rng = random.Random(2)
    words = ["", "a", "é" * 40, *("".join(rng.choices("abcé", k=rng.randint(0, 30))) for _ in range(500))]
    seeds = [rng.randbytes(5) for _ in words]
    got = variants.crc32_behind(np.array([zlib.crc32(s) for s in seeds], dtype=np.uint32), pa.array(words))
    assert got.tolist() == [zlib.crc32(s + w.encode()) for s, w in zip(seeds, words)]


def test_runs_are_spaced(spelled):
    texts = [t for _, t, _ in spelled] + ["ÀÿĀ¿ Ünïcode中文àb", "ÃƒÂ©"]
    for text, got in zip(texts, variants.spaced(pa.array(texts)).to_pylist()):
        assert got.encode("utf-8", "surrogateescape").split() == [r.translate({c: c + 32 for c in range(65, 91)}).encode() for r in re.findall("[A-Za-zÀ-ÿ]+", text or "")]


# --- fill in middle ----------------------------------------------------------------------------------------------------

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain_fill(i, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(tag in text for tag in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_middle(spark):
    rng = random.Random(4)
    parts = ["word", " ", "\n\n", "\t", "\x0b\x0c", "\x1c", "\x85", "\xa0", "é", "😀", "文", "<", "<P", "S>", ">", "<M", "  ", "é"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 40))), "en") for i in range(400)]
    rows += [(i, t, "en") for i, t in enumerate([None, "", " ", "a <P> b", "<M>", "x<S>", "long word " * 40_000, " " * 50_000], 400)]
    rows += [(5, "same id, other text", "en"), (None, "no id", None), (None, None, None), *[(7, "repeated rows here", "en")] * 40, *[(8, "repeated rows here", "en")] * 40]
    made = fill_middle.transform(frame(spark, rows)).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect())
    assert got == Counter((i, *plain_fill(i, t), t or "") for i, t, _ in rows)
    assert {form for _, _, form, *_ in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(frame(spark, [])).count() == 0


def test_units_stay_where_their_text_was_dealt(spark):
    """The texts cross the network once; of the rest only a key for each row does."""
    made = fill_middle.transform(frame(spark, [(i, f"some words of text {i}", "en") for i in range(50)]))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 4  # the rows' keys, and the texts for themselves, units and requests: one, reused
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = fill_middle.transform(frame(spark, [(i, f"some words of text {i}", "en") for i in range(50)]))
        plan = again._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ReusedExchange") >= 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


# --- language ----------------------------------------------------------------------------------------------------------


def plain_words(text):
    lowered = "".join(c.lower() for c in text or "")
    return "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in lowered).split(" ")


def plain_grams(word, n):
    padded = f" {word} "
    return [(j, padded[j : j + n]) for j in range(len(padded) - n + 1) if n > 1 or padded[j] != " "]


def plain_model(rows):
    learned = [(t, g) for i, t, g in rows if i is not None and t is not None and g is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    languages = [g for g, _ in sorted(Counter(g for _, g in learned).items(), key=lambda x: (-x[1], x[0]))]
    counts = [{g: Counter() for g in languages} for _ in range(6)]
    for t, g in learned:
        for w in filter(None, plain_words(t)):
            counts[0][g][w] += 1
            for n in range(1, 6):
                counts[n][g].update(s for _, s in plain_grams(w, n))
    return languages, counts


def plain_prediction(model, text):
    languages, counts = model
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    known = [set().union(*level.values()) for level in counts]

    def score(n, s):
        return np.array([math.log((counts[n][g][s] + 0.5) / (sum(counts[n][g].values()) + 0.5 * max(1, len(known[n])))) for g in languages])

    z = np.zeros(len(languages))
    for w in filter(None, plain_words(text)):
        if w in known[0]:
            z += score(0, w)
            continue
        grams = {n: dict(plain_grams(w, n)) for n in range(1, 6)}
        found = []
        for j in range(len(w) + 2):
            n = next((n for n in range(5, 0, -1) if grams[n].get(j) in known[n]), None)
            if n:
                found.append(score(n, grams[n][j]))
        z += np.mean(found, axis=0) if found else 0
    p = np.exp(z - z.max())
    return languages[int(z.argmax())], float(p.max() / p.sum())


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(6)
    parts = {"aa": ["tra", "lon", "é", "vi", "ß"], "bb": ["kol", "vi", "mun", "da", "л"], "cc": ["lon", "su", "ñ", "pe"]}
    rows = []
    for i in range(160):
        lang = rng.choice("aab") * 2 if i % 7 else "cc"
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))).title() for _ in range(rng.randint(1, 12))) + rng.choice([".", " 42!", "\n", ""]), lang))
    return rows + [(200, None, "aa"), (201, "", "bb"), (202, "12 + 3 = 15 ...", "bb"), (203, "文字だけ", None), (204, "q" * 5000 + " tralon", "aa"), (None, "tralon vi", "aa"), (205, "kol mun da", None), (3, "su su ñpe", "cc"), (206, "́́ 5", "aa")]


def test_language_id(spark, spoken):
    docs = frame(spark, spoken)
    found = language_id.predict_texts(docs, language_id.train(docs))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.lang_pred, round(r.score, 5)) for r in found.collect())
    model = plain_model(spoken)
    expected = sorted((i is None, i or 0, lang, round(score, 5)) for i, t, _ in spoken for lang, score in [plain_prediction(model, t)])
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert np.allclose([g[3] for g in got], [e[3] for e in expected], atol=1e-4)
    held = [(i, g) for i, t, g in spoken[:160] if zlib.crc32(str(i).encode()) % 4 == 2]
    right = {i: lang for _, i, lang, _ in got}
    assert np.mean([right[i] == g for i, g in held]) > 0.9


def test_what_a_language_model_learns_is_bounded(spark, spoken):
    docs = frame(spark, spoken)
    model = language_id.train(docs, cells=90)
    assert all(len(h) <= 30 for h in model.hashes) and model.languages[0] in ("aa", "bb")
    few = language_id._labelled(docs, "doc_id", "text", "lang", 10)[1]
    assert 0 < few.count() < 60
    nothing = language_id.train(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in language_id.predict_texts(docs, nothing).collect()} == {("und", 0.0)}
    assert language_id.predict_texts(docs.limit(0), model).count() == 0
