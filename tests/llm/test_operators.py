"""The training-data operators on small fixtures, against plain versions of what they compute."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from namelattice import storage
from namelattice.llm import bagminhash, decontam, labelled, licenses, line_dedup, mixing, quality, token_counts, token_orc, tokens, toxicity, vector_dedup
from namelattice.llm.queries import tokenizer_path
from namelattice.llm.words import WORD_PATTERN, words_of
from namelattice.operators import components

DOCS = "doc_id long, text string, source string, score double, size string, h string, key long, n long, t string, doc string"


def frame(spark, rows):
    """Documents with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, s, 0.5, "x", "y", 1, 2, "z", "w") for i, t, s in rows], DOCS).repartition(3)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "Éa", "naïve", "x9", "…"]
    made = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 20, 60, 200]))) for _ in range(40)]
    near = []
    for text in made[:15]:
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    odd = ["", None, "   \n\t", "one", "!!! ,,,", "a\x1cb <|endoftext|> don't İstanbul Σς", "word " * 3000, made[0], made[0], made[1].upper()]
    return made + near + odd


def test_words_follow_the_pattern(texts):
    for text in texts:
        assert [w.decode() for w in words_of((text or "").encode())] == plain_words(text)
    assert WORD_PATTERN in r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    found = dict(components.connected_components(edges).collect())
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(tokenizer_path()), tokens.BatchEncoder(tokenizer_path(), limit=300)
    rng = random.Random(1)
    parts = list("abcXYZ '.,!?09\n\t\x1c\x85 éÉßµªŉſıİΣσςłœ中文́") + ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", "don't", "😀", " "]
    cases = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)] + [None, "", " "]
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in cases]
    ids, ends = codec.encode(pa.array(cases))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == expected
    assert codec.counts(pa.array(cases), {b"abc": 1}).tolist() == [len(x) for x in expected]
    assert codec.encode(pa.array([], pa.string()))[0].tolist() == []


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, tokenizer_path(), table_size=50).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(docs.limit(0), tokenizer_path()).count() == 0


def test_frequent_pieces_of_a_sample(spark):
    front = [(i, f"front{i} hot " * 3, "s") for i in range(600)]
    rest = [(1000 + i, "x " * 11_000 + "behind behind behind", "s") for i in range(20)] + [(2000 + i, "often often often other", "s") for i in range(700)] + [(3000, "y" * 300, "s"), (3001, None, "s"), (3002, "", "s")]
    docs = spark.createDataFrame(front + rest, "doc_id long, text string, source string").coalesce(2)
    found = token_counts.frequent_lengths(docs, tokenizer_path(), table_size=5)
    assert set(found) == {b"x", b"often", b"hot", b"other", b"behind"}
    few = token_counts.frequent_lengths(docs, tokenizer_path(), sample_docs=60)
    assert {b"often", b"hot"} <= set(few) and 5 < sum(piece.startswith(b"front") for piece in few) < 100
    assert token_counts.frequent_lengths(docs.limit(0), tokenizer_path()) == {}


def test_pre_tokens_are_not_shuffled(spark, texts, monkeypatch):
    """The sample's texts are dealt to a fixed number of tasks before they are cut; nothing is dealt after."""
    plans = []
    to_arrow = type(spark.range(0)).toArrow
    monkeypatch.setattr(type(spark.range(0)), "toArrow", lambda self: plans.append(self) or to_arrow(self))
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "no id", None), (None, "no id", None)]
    docs = frame(spark, rows)
    counted = token_counts.count_tokens(docs, tokenizer_path())
    assert counted.where("doc_id IS NULL").count() == 2
    for plan in [*plans, counted]:
        lines = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
        cut = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
        assert not any("Exchange" in line for line in lines[:cut])
    assert len(plans) == 1 and plans[0]._jdf.queryExecution().executedPlan().toString().count(f"RoundRobinPartitioning({token_counts.SAMPLE_TASKS})") >= 1


def test_token_files_round_trip(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rows = [(None, "no id", "s"), *((i * 3 % 101, t, "s") for i, t in enumerate(texts))]
    token_orc.write_tokens(frame(spark, rows), str(tmp_path / "t"), tokenizer_path())
    back = token_orc.read_tokens(spark, str(tmp_path / "t"))
    got = sorted(((r.start, r.doc_id, list(r.ids)) for r in back.collect()))
    assert [d for _, d, _ in got] == [None] + sorted(i for i, *_ in rows[1:])
    expected = sorted([(i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in rows[1:]])
    assert sorted((d, ids) for _, d, ids in got[1:]) == expected
    assert [s for s, *_ in got] == np.concatenate([[0], np.cumsum([len(x) for *_, x in got])[:-1]]).tolist()
    for r in token_orc.digest(back).collect():
        ids = next(x for s, _, x in got if s == r.start)
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
    assert back.where("doc_id = 3").count() == sum(i == 3 for i, *_ in rows)
    assert token_orc.token_file_rows(frame(spark, []), tokenizer_path()).count() == 0


def plain_windows(doc, item):
    n = min(10, len(item))
    windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
    return [i for i in range(len(doc) - n + 1) if tuple(doc[i : i + n]) in windows], n


def plain_near(bodies, item, within=20):
    """Which of ``bodies`` (lists of words) have a window's rarest word with all its other words near it."""
    count = Counter(w for body in bodies for w in body)
    windows = {tuple(item[i : i + 10]) for i in range(max(1, len(item) - 9))} if item else set()
    out = []
    for body in bodies:
        hit = False
        for window in windows:
            rare = min(window, key=lambda w: (count[w], w.encode()))
            hit = hit or any(w == rare and set(window) <= set(body[max(0, p - within) : p + within + 1]) for p, w in enumerate(body))
        out.append(hit)
    return out


def by_id(x):
    return (x[0] is None, x[0] or 0, *x[1:])


@pytest.mark.parametrize("block_words, step", [(10_000, 500_000), (20, 7)])
def test_decontamination(spark, texts, block_words, step, monkeypatch):
    monkeypatch.setattr(decontam, "STEP", step)
    passage = (texts[3] or "").split(" ")
    items = [(1, " ".join(passage[5:25])), (2, "short item"), (3, None), (4, texts[4]), (12, "short item"), (None, "w1 unseen"), (13, "item item here"), (14, " ".join(texts[2].split(" ")[:60]))]
    shuffled = passage[5:15]
    random.Random(1).shuffle(shuffled)
    docs = [(i, t, "s") for i, t in enumerate(texts)]
    docs += [(900, "a Short, ITEM here short item", "s"), (900, "x short item", "s"), (None, "short item", "s"), (901, "item x short", "s"), (902, " ".join(shuffled), "s")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.match_items(frame(spark, docs), table, block_words=block_words, segment_words=500).collect()
    bodies = [plain_words(t) for _, t, _ in docs]
    near = {str(item) if item is not None else "": plain_near(bodies, plain_words(body)) for item, body in items}
    expected = []
    for k, (i, _, _) in enumerate(docs):
        words, hit, found = bodies[k], set(), set()
        for item, body in items:
            starts, n = plain_windows(words, plain_words(body))
            if n and starts:
                found.add(str(item) if item is not None else "")
                hit |= {p for s in starts for p in range(s, s + n)}
        expected.append((i, len(words), len(hit), sorted(found), sorted(x for x, hits in near.items() if hits[k])))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), list(r.near_items)) for r in got), key=by_id) == sorted(expected, key=by_id)
    assert any(len(x[4]) > len(x[3]) for x in expected) and all(set(x[3]) <= set(x[4]) for x in expected)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
    kept = decontam.drop_contaminated(frame(spark, docs), table)
    assert kept.columns == frame(spark, docs).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _, n, *_ in expected if n == 0 and i is not None)
    assert decontam.match_items(frame(spark, docs), table.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.match_items(frame(spark, docs), table.limit(0)).count() == len(docs)
    assert decontam.match_items(frame(spark, []), table).count() == 0


def test_one_index_serves_all_test_sets(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 64)
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    index = decontam.build_index(docs, str(tmp_path / "index"), segment_words=700)
    assert index.count() > 2
    stored_words = Counter()
    for r in index.collect():
        for term, low, high in zip(r.terms, [0, *r.ends], r.ends):
            stored_words[bytes(term).decode()] += high - low
    assert stored_words == Counter(w for t in texts for w in plain_words(t))
    for body in (" ".join(texts[5].split(" ")[:12]), " ".join(texts[9].split(" ")[-15:]), "one"):
        items = spark.createDataFrame([(1, body)], "item_id long, text string")
        got = {r.doc_id for r in decontam.search(decontam.read_index(spark, str(tmp_path / "index")), items).collect() if r.n_hit}
        assert got == {i for i, t in enumerate(texts) if plain_windows(plain_words(t), plain_words(body))[0]} and got


@pytest.mark.parametrize("size, piece", [(1, 8), (60, 40), (10_000, 1 << 20)])
def test_words_are_listed_in_order(texts, size, piece, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", piece)
    rows = [*texts, None, "", " -", "A" * 50, "é, B " * 40]
    segment, counts = decontam._Segment(), []
    for start, words, sizes in decontam._worded(pa.array(rows), size):
        assert start == len(counts)
        counts += sizes.tolist()
        segment.add([(start + i, start + i, 0) for i in range(len(sizes))], words, sizes)
    bodies = [plain_words(t) for t in rows]
    assert counts == [len(body) for body in bodies]
    (part,) = segment.batch().to_pylist()
    assert part["row"] == list(range(len(rows))) and part["terms"] == sorted(part["terms"])
    expected = {}
    for place, body in zip(part["places"], bodies):
        for i, word in enumerate(body):
            expected.setdefault(word.encode(), []).append(place + i)
    at = np.cumsum(part["steps"]).tolist()
    assert {term: at[low:high] for term, low, high in zip(part["terms"], [0, *part["ends"]], part["ends"])} == expected


def test_order_of_many_codes():
    codes = np.random.default_rng(1).integers(0, 200_000, 50_000).astype(np.int32)
    assert (decontam._ordered(codes, 200_000) == np.argsort(codes, kind="stable")).all()
    assert (decontam._ordered(codes % 1000, 1000) == np.argsort(codes % 1000, kind="stable")).all()


def test_blocks_of_the_test_set_are_bounded(spark):
    words = [f"w{i}" for i in range(95)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "a b c"), (3, None)], "item_id long, text string")
    blocks = list(decontam.item_blocks(items, "item_id", "text", 10, 30))
    assert all(sum(len(w) for _, w in block) <= 30 for block in blocks)
    windows = {tuple(w[i : i + 10]) for block in blocks for item, w in block if item == "1" for i in range(len(w) - 9)}
    assert windows == {tuple(f"w{i}".encode() for i in range(k, k + 10)) for k in range(86)}


def test_near_matches(spark, tmp_path):
    docs = frame(spark, [(1, "alpha x x beta", "s"), (2, "alpha" + " x" * 30 + " beta", "s"), (3, "beta", "s"), (4, "alpha", "s"), (5, None, "s")])
    index = decontam.build_index(docs, str(tmp_path / "index"))
    assert [(r.doc_id, r.position) for r in decontam.near_matches(index, "Beta alpha", within=5).collect()] == [(1, 0)]
    assert decontam.near_matches(index, "").count() == 0


def plain_classes(docs):
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := plain_words(t)) else Counter() for _, t, _ in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if bags[i] and bags[j] and (bags[i] & bags[j]).total() / (bags[i] | bags[j]).total() >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i][0])
    return sorted((docs[i][0], min(groups[find(i)]), len(groups[find(i)])) for i in range(len(docs)))


def test_near_duplicate_documents(spark, texts):
    docs = [(i * 7 % 97, t, "s") for i, t in enumerate(texts)]
    got = bagminhash.classes(frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == plain_classes(docs)
    stay = bagminhash.drop_near_duplicates(frame(spark, docs))
    assert stay.columns == frame(spark, docs).columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted({c for _, c, _ in plain_classes(docs)})
    assert bagminhash.classes(frame(spark, [])).count() == 0


def test_near_duplicates_with_nulls_and_repeated_rows(spark):
    body = " ".join(f"t{i}" for i in range(30))
    docs = frame(spark, [(None, body, "s"), (None, body, "s"), (5, "other words stand in this text", "s"), (5, "other words stand in this text", "s"), (5, body, None), (6, None, "s"), (7, "", "s")])
    assert sorted(str(r.doc_id) + str(r.text)[:5] for r in bagminhash.drop_near_duplicates(docs).collect()) == ["5other", "5t0 t1", "6None", "7"]
    nameless = frame(spark, [(None, body, "s"), (None, body + " more", "s")])
    assert bagminhash.drop_near_duplicates(nameless).count() >= 1


def test_near_copies_of_one_text_in_thousands(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"u{i}x{rng.random()}"
        docs.append((i, " ".join(words), "s"))
    got = bagminhash.classes(frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == plain_classes(docs)


def test_signatures_estimate_weighted_overlap():
    rng = np.random.default_rng(3)
    element = rng.integers(1, 2**62, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    sig = bagminhash.signatures(np.tile(element, 2), np.repeat([0, 1], 300), np.concatenate([a, b]), 2, 4096)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - truth) < 0.04


def plain_links(rows):
    ok = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, dtype=float)
            ok.setdefault(len(v), []).append((i, u / np.linalg.norm(u)))
    links = {}
    for same in ok.values():
        for i, u in same:
            links.setdefault(i, set()).update(j for j, w in same if j != i and u @ w >= 0.9)
    out = []
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links.get(todo.pop(), ()) if j not in seen and not seen.add(j)]
        out.append((i, len(links.get(i, ())), min(seen), i == min(seen)))
    return sorted(out)


def test_near_duplicate_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)]
    base = rng.normal(size=8)
    rows += [(200 + i, (base + 0.15 * rng.normal(size=8)).tolist()) for i in range(60)] + [(300 + i, base.tolist()) for i in range(5)]
    rows += [(400, None), (401, [0.0] * 8), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, []), (405, [1.0, 2.0]), (406, [2.0, 4.0])]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string").repartition(3)
    got = vector_dedup.near_duplicates(table).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == plain_links(rows)
    assert vector_dedup.near_duplicates(table.limit(0)).count() == 0


def test_links_in_a_crowd_of_vectors(spark, monkeypatch):
    rng = np.random.default_rng(9)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    # A third of all rows has a mutual cosine of 0.8; one in forty of them has a partner at 0.905.
    center = unit(rng.normal(size=64))
    x = unit(rng.normal(size=(20_000, 64)))
    off = unit(x[:6666] - np.outer(x[:6666] @ center, center))
    x[:6666] = 0.8**0.5 * center + 0.2**0.5 * off
    twin = unit(rng.normal(size=(166, 64)))
    twin -= (twin * x[:166]).sum(axis=1, keepdims=True) * x[:166]
    x[6500:6666] = 0.905 * x[:166] + (1 - 0.905**2) ** 0.5 * unit(twin)
    cosines = x @ x.T
    np.fill_diagonal(cosines, 0)
    linked = {i: int(n) for i, n in enumerate((cosines >= 0.9).sum(axis=1)) if n}
    assert len(linked) >= 332
    table = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.array(list(x))}))
    # A window wider than the table; then narrow ones, in spans.
    for window, recall in ((20_000, 1.0), (512, 0.98)):
        monkeypatch.setattr(vector_dedup, "WINDOW", window)
        monkeypatch.setattr(vector_dedup, "SPAN", 4 * window)
        got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(table).where("n_links > 0").collect()}
        assert got.keys() <= linked.keys() and len(got) >= recall * len(linked)
        assert all(n <= linked[i] for i, n in got.items())


@pytest.mark.parametrize("common", [0.0, 0.5, 0.75])
def test_recall_of_vectors_with_a_common_direction(spark, monkeypatch, common):
    rng = np.random.default_rng(int(common * 100))

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    # 200 pairs at cosine 0.905, each far from all others; ``common`` is the mean cosine of the table.
    center = unit(rng.normal(size=128))
    x = unit(rng.normal(size=(4100, 128)))
    x = common**0.5 * center + (1 - common) ** 0.5 * unit(x - np.outer(x @ center, center))
    turn = unit(rng.normal(size=(200, 128)))
    turn = unit(turn - (turn * x[:200]).sum(axis=1, keepdims=True) * x[:200])
    x[-200:] = 0.905 * x[:200] + (1 - 0.905**2) ** 0.5 * turn
    x = x.astype(np.float32)
    exact = unit(x.astype(float)) @ unit(x.astype(float)).T
    np.fill_diagonal(exact, 0)
    linked = {i: int(n) for i, n in enumerate((exact >= 0.9).sum(axis=1)) if n}
    assert len(linked) >= 400
    monkeypatch.setattr(vector_dedup, "WINDOW", 128)
    monkeypatch.setattr(vector_dedup, "SPAN", 512)
    table = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.array(list(x))}))
    assert vector_dedup._kind(table, "embedding") == "<f4"
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(table).where("n_links > 0").collect()}
    assert got.keys() <= linked.keys() and len(got) >= 0.99 * len(linked)
    assert all(got[i] == linked[i] for i in got)


def test_links_of_a_component_with_a_core(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 64)
    monkeypatch.setattr(vector_dedup, "CENTRE_OF", 16)
    rng = np.random.default_rng(31)
    base = rng.normal(size=16)
    # Near copies that are all core, others strewn around them, and a component of core alone.
    rows = [(i, (base + s * np.linalg.norm(base) / 4 * rng.normal(size=16)).tolist()) for i, s in enumerate([0.05] * 300 + [0.3] * 250)]
    rows += [(1000 + i, (-base + 0.01 * rng.normal(size=16)).tolist()) for i in range(150)] + [(2000 + i, rows[i][1]) for i in range(5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_dedup.near_duplicates(table).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == plain_links(rows)


def test_vectors_with_null_ids_and_repeated_rows(spark):
    rows = [(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [0.0, -1.0]), (5, None), (None, None), (9, [2.0, 0.1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, vector_dedup.near_duplicates(table).collect()), key=repr)
    assert got == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, 0, None, True), (5, 0, 5, True), (None, 0, None, True), (9, 3, 3, False)], key=repr)


def plain_mix(docs, kept_keys):
    sizes, sources = {}, {}
    for i, t, s in docs:
        sizes[i] = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sources.setdefault(s, []).append(i)
    names = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    total = {s: sum(sizes[i] for i in sources[s]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(total.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= over
    return sizes, {i: (total[s], target[s]) for s in names for i in sources[s]}, target


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(["word"] * rng.randint(0, 60)) + "!" * rng.randint(0, 30), rng.choice(["a", "a", "a", "a", "b", "c", "d", "Z", None])) for i in range(900)]
    docs += [(2000, None, "a"), (2001, "", "only empty")]
    sizes, known, target = plain_mix(docs, None)
    small = {"per_unit": 1, "cuts": 4, "ordered": 5}
    got = mixing.plan(frame(spark, docs), **small).collect()
    taken = Counter()
    by_id = {i: s for i, _, s in docs}
    for r in got:
        assert r["size"] == sizes[r.doc_id] and r.source_size == known[r.doc_id][0]
        assert r.target == pytest.approx(known[r.doc_id][1], rel=1e-9, abs=1e-9) and r.copies <= 2
        taken[by_id[r.doc_id]] += r["size"] * r.copies
    for s, goal in target.items():
        assert abs(taken[s] - goal) <= 60
    again = mixing.plan(frame(spark, docs[::-1]), **small).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)
    rows = mixing.mixed(frame(spark, docs), **small)
    assert rows.columns == frame(spark, docs).columns
    assert Counter(r.doc_id for r in rows.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.plan(frame(spark, [])).count() == 0


@pytest.mark.parametrize("marks", [0, 100, 3])
def test_border_rows_are_few_whatever_the_weights(spark, marks):
    # One source of equal low weights (0.05 for 100 marks), one of half of the rows copies of one row.
    body = F.concat(F.lit("a b c d" + " !" * marks), F.lit(" w"), F.col("id"))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), body.alias("text"), F.lit("s").alias("source"))
    same = spark.range(4000).select(F.when(F.col("id") < 2000, F.lit(-1)).otherwise(-F.col("id")).alias("doc_id"), F.lit("x y" + " !" * marks).alias("text"), F.lit("t").alias("source"))
    docs = docs.unionByName(same)
    columns = mixing.sampling_columns(F.col("doc_id"), F.col("text"))
    sized = docs.select(mixing.source_key(F.col("source")).alias("sk"), *(c.alias(n) for n, c in columns.items())).cache()
    slices = mixing._slices(sized.withColumn("slice", F.floor(F.ln("key") * mixing.SLICES).cast("int")))
    goals = sized.groupBy("sk").agg((F.sum("size") * 0.37).alias("rest"))
    at, rows = mixing.border_rows(sized, goals, slices, cuts=8, ordered=50)
    groups = {r.sk: (r.n, r.k) for r in rows.groupBy("sk").agg(F.count("*").alias("n"), F.countDistinct("key").alias("k")).collect()}
    assert groups.keys() == {"=s", "=t"} and all(n <= 50 or k == 1 for n, k in groups.values())
    assert {r.sk: r.n for r in at.collect()} == {sk: n for sk, (n, _) in groups.items()}
    got = mixing.plan(docs, total=0.37, weights=(5, 1), ordered=50, cuts=8)
    taken = {r["size"]: (r.taken, r.target) for r in got.groupBy("size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()}
    small, large = sorted(taken)
    assert abs(taken[large][0] - taken[large][1]) <= large
    # The copies of one row are taken or left together.
    assert abs(taken[small][0] - taken[small][1]) <= 2000 * small
    assert len({r.copies for r in got.where("doc_id = -1").collect()}) == 1


def test_mixing_with_null_ids_and_repeated_rows(spark):
    docs = [(None, "one two three", "a")] * 3 + [(None, "four", "a"), (7, "x y", None), (7, "x y", None), (7, "other", "b"), (8, None, "b")]
    got = mixing.plan(frame(spark, docs), ordered=1, cuts=2, per_unit=1).collect()
    assert len(got) == len(docs) and len({r.copies for r in got if r["size"] == 3}) == 1
    assert Counter(r["size"] for r in got) == Counter({3: 3, 1: 2, 2: 2, 0: 1})


def test_mixing_prefers_weight(spark):
    docs = [(i, "plain words only here", "s") if i % 2 else (i, "!! ## bad && mark", "s") for i in range(600)] + [(10_000 + i, "x " * 100, "t") for i in range(10)]
    got = {r.doc_id: r.copies for r in mixing.plan(frame(spark, docs), total=0.5, weights=(1, 1)).collect()}
    assert sum(got[i] for i in range(1, 600, 2)) > 2 * sum(got[i] for i in range(0, 600, 2))


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [5, 1])
def test_line_dedup(spark, least):
    rng = random.Random(9)
    pool = [" ".join(rng.choices("a b c d e f g".split(), k=rng.choice([1, 3, 5, 6, 7, 7, 8]))) for _ in range(60)]
    for line in list(pool):
        words = line.split(" ")
        at = rng.randrange(len(words))
        pool += [" ".join(words[:at] + words[at + 1 :]), " ".join(words[:at] + ["z"] + words[at + 1 :]), " ".join(words[:at] + ["z"] + words[at:])]
    template = [f"id {i} of this one template line" for i in range(40)]
    long = " ".join(f"q{i}" for i in range(700))
    docs = [(i, "\n".join(rng.choices(pool + template, k=6) + ["", "  "]), "s") for i in range(40)]
    docs += [(100, long, "s"), (101, long.replace("q333", "zz"), "s"), (102, long.replace(" q64 ", " "), "s"), (103, None, "s"), (104, "", "s")]
    seen, near_of, expected = {}, {}, []
    for i, t, _ in docs:
        for pos, raw in enumerate((t or "").split("\n")):
            line = " ".join(re.findall(r"[^ \t\r\x0b\x0c]+", raw))
            if not line:
                continue
            words = line.split(" ")
            if line in seen:
                state = 1
            else:
                state = 2 if len(words) >= least and any(len(o) >= least and abs(len(o) - len(words)) <= 1 and word_distance(o, words) <= 1 for o in seen.values()) else 0
                seen[line] = words
            expected.append((i, pos, state))
    assert {s for *_, s in expected} == {0, 1, 2}
    got = line_dedup.line_states(frame(spark, docs), min_words=least).collect()
    assert sorted((r.doc_id, r.pos, r.state) for r in got) == sorted(expected)
    dropped = {(i, pos) for i, pos, s in expected if s}
    texts = {r.doc_id: r.text for r in line_dedup.cleaned(frame(spark, docs), min_words=least).collect()}
    assert texts == {i: t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in dropped) for i, t, _ in docs}
    assert len(line_dedup.summary(frame(spark, docs)).collect()) == len(docs)
    assert line_dedup.summary(frame(spark, [])).count() == 0


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"][2]
    docs = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence"), "s"),
        (2, "words\nreleased under the mit licence\nmore", "s"),
        (3, "Licensed  under the Apache License, v2.0", "s"),
        (4, "see: Released under the MIT License. And more.", "s"),
        (5, None, "s"), (6, "", "s"), (6, "", "s"), (7, "...\n!!", "s"), (None, "Released under the MIT License.", "s"),
    ]
    got = sorted(map(tuple, licenses.scan(frame(spark, docs)).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == [
        (1, "MIT", 1, "MIT"), (2, None, 1, "MIT"), (3, "Apache-2.0", 1, "Apache-2.0"), (4, None, 0, ""), (5, None, 0, ""),
        (6, None, 0, ""), (6, None, 0, ""), (7, None, 0, ""), (None, "MIT", 1, "MIT"),
    ]
    assert licenses.scan(frame(spark, [])).count() == 0


def test_usual_license_files(spark):
    folder = Path(licenses.__file__).parent / "license_texts"
    full = {p.stem: p.read_text() for p in folder.glob("*.txt")}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"} <= full.keys()
    mit, isc, apache = licenses.KNOWN["MIT"][2], licenses.KNOWN["ISC"][0], licenses.KNOWN["Apache-2.0"][1]
    texts = [("MIT", "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit), ("ISC", "The ISC License\n\nCopyright (c) 2021, A B\n\n" + isc)]
    texts += [("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2021, A B\nAll rights reserved.\n\n" + full["BSD-3-Clause"])]
    texts += [("Apache-2.0", full["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2019 A B"))] + list(full.items())
    texts += [("MIT", "SPDX-License-Identifier: MIT")]
    got = {r.doc_id: r.whole_license for r in licenses.scan(frame(spark, [(i, t, "s") for i, (_, t) in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == [name for name, _ in texts]
    # One canonical form belongs to one licence.
    rows = [(name, text) for name, each in licenses.KNOWN.items() for text in each]
    table = spark.createDataFrame(rows, "license string, text string").groupBy(licenses.canonical(F.col("text"))).agg(F.collect_set("license").alias("names"))
    assert [r.names for r in table.where("size(names) > 1").collect()] == []
    # Wrapped blocks inside other text.
    header = "/*\n * " + apache.replace("\n", "\n * ") + "\n *\n */\n\nint main;"
    rewrapped = "x\n" + "\n".join(re.findall(r"\S+(?: \S+){0,4}", " ".join(mit.split()))) + "\ny"
    odd = "MIT License\nPermission is hereby granted " * 500
    docs = [(1, header, "s"), (2, "About.\n\nMIT License\n\nCopyright (c) 2020 S\n\n" + mit + "\n\nEnd.", "s"), (3, mit, "s"), (4, "a\n\n" + mit[:-9], "s"), (None, "x\n\n" + isc, "s"), (6, None, "s")]
    docs += [(7, rewrapped, "s"), (8, "\n".join([mit, "some words", isc, "Licensed under CC BY 4.0."]), "s"), (9, odd, "s"), (10, "word " * 200_000 + "\nLicensed under the MIT Licence.", "s"), (11, mit + " more", "s")]
    got = licenses.scan(frame(spark, docs)).collect()
    assert sorted((r.doc_id or 0, r.whole_license, r.n_notices, r.licenses) for r in got) == [
        (0, None, 1, "ISC"), (1, None, 1, "Apache-2.0"), (2, None, 1, "MIT"), (3, "MIT", 1, "MIT"), (4, None, 0, ""), (6, None, 0, ""),
        (7, None, 1, "MIT"), (8, None, 3, "CC-BY-4.0,ISC,MIT"), (9, None, 0, ""), (10, None, 1, "MIT"), (11, None, 0, ""),
    ]


def test_licenses_of_ones_own(spark):
    docs = frame(spark, [(1, "Alpha & Beta!\nx", "s"), (2, "alpha and\nbeta", "s"), (3, "one two three four five six", "s"), (4, "alpha beta", "s"), (5, "!!", "s")])
    known = licenses.known_digests(spark, {"A": ["alpha and beta"], "B": ["One two, three four five six", "!!"], "C": ["alpha and beta"]})
    got = {r.doc_id: (r.whole_license, r.n_notices) for r in licenses.scan(docs, known).collect()}
    assert got == {1: (None, 1), 2: ("A", 1), 3: ("B", 1), 4: (None, 0), 5: (None, 0)}
    # Each known text has a telling word, in any spelling.
    default = licenses.known_digests(spark)
    assert all(any(w in text.lower() for w in default.telling) for texts in licenses.KNOWN.values() for text in texts)
    assert licenses.scan(docs, licenses.known_digests(spark, {})).where("n_notices > 0").count() == 0


def test_factorization_machine_learns_pairs():
    rng = np.random.default_rng(0)
    terms, y = [], []
    for _ in range(6000):
        one, two = rng.random(2) < 0.5
        words = [b"fill%d" % i for i in rng.choice(300, 8)] + [b"insult"] * int(one) + [b"group"] * int(two)
        terms.append(toxicity.term_ids(b" ".join(words)))
        y.append(float(one != two))  # no linear weights can express this
    y = np.array(y)
    model = toxicity.fit(np.concatenate(terms[:5000]), np.cumsum([len(t) for t in terms[:5000]]), y[:5000], epochs=12)
    found = np.array([model.score(t) >= 0.5 for t in terms[5000:]])
    assert (found == (y[5000:] > 0)).mean() > 0.9


def test_factorization_scores_equal_a_plain_sum_over_pairs():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}longer" for x in rng.integers(0, 50, rng.integers(0, 40))) for _ in range(60)] + ["", "!!", "w1"]
    size = 1 << toxicity.BITS
    row = np.where(rng.random(size) < 0.6, np.arange(size), -1).astype(np.int32)
    model = toxicity.FactorizationMachine(row, 0.3, rng.normal(size=size).astype(np.float32) * 0.1, rng.normal(size=(size, 4)).astype(np.float32) * 0.3)
    flat, ends = toxicity.terms(pa.array(texts))
    got = model.scores(flat, ends)
    for text, score in zip(texts, got):
        ids = [i for i in set(toxicity.term_ids(text.encode()).tolist()) if row[i] >= 0]
        z = model.bias + sum(float(model.weights[i]) for i in ids)
        z += sum(float(model.factors[i].astype(float) @ model.factors[j].astype(float)) for k, i in enumerate(ids) for j in ids[:k]) / max(1, len(ids))
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_terms_of_many_texts_are_those_of_each(texts):
    def plain(text):
        found = set()
        for word in set(plain_words(text)):
            raw = word.encode()
            for part in [raw, *(raw[:n] for n in (3, 4, 5, 6) if len(raw) > n)]:
                if len(part) > toxicity.SHORT:
                    h = xxhash.xxh3_64_intdigest(part)
                else:
                    h = 0xCBF29CE484222325
                    for byte in part:
                        h = (h ^ byte) * 0x100000001B3 % 2**64
                if part != raw:
                    h = (h + 0x9E3779B97F4A7C15 * len(part)) % 2**64
                found.add(((h ^ (h >> 31)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS))
        return sorted(found)

    cases = [*texts, "x" * 5000 + " y" * 3 + " ab abc abcd abcdefgh ABC", None, "É" * 30]
    flat, ends = toxicity.terms(pa.array(cases, pa.string()).slice(1))
    assert [x.tolist() for x in np.split(flat, ends[:-1])] == [plain(t) for t in cases[1:]]
    assert [x.tolist() for x in (toxicity.term_ids(b""), toxicity.terms(pa.array([], pa.string()))[1])] == [[], []]


def test_repeated_ids_are_learned_alike(spark):
    docs, labels = labelled_docs(spark, 200)
    again = frame(spark, [(i, f"plain{i % 100} the other text of this id !!", "s") for i in range(200)])
    scores = []
    for table in (docs.unionByName(again), again.unionByName(docs).repartition(5)):
        fm, forest = toxicity.train(table, labels), quality.train(table, labels)
        scores.append((fm.bias, fm.weights.tolist(), forest.value.tolist(), forest.split.tolist()))
    assert scores[0] == scores[1]
    lengths = {r.doc_id: r.score for r in toxicity.score_texts(frame(spark, [(1, "word " * 300_000 + "end", "s"), (2, None, "s")]), fm).collect()}
    assert lengths.keys() == {1, 2} and all(0 <= x <= 1 for x in lengths.values())


def test_quality_statistics_equal_plain_counts():
    text = "The cat, the cat!!\nTHE cat | sat 42\n\nThe cat, the cat!!\n\tnaïve <b>"
    raw = text.encode()
    got = dict(zip(quality.STATISTICS, quality.statistics(raw)))
    n, words = len(raw), raw.split()
    share = lambda test: sum(map(test, raw)) / n
    assert got["lower"] == share(lambda b: 97 <= b <= 122) and got["upper"] == share(lambda b: 65 <= b <= 90) and got["digit"] == 2 / n
    assert got["space"] == share(lambda b: b in b" \t\n") and got["bang"] == 4 / n and got["bar"] == 1 / n and got["symbol"] == 2 / n
    assert got["stop"] == 2 / n and got["beyond_ascii"] == 2 / n and got["newline"] == raw.count(b"\n") / n
    assert got["log_bytes"] == np.log1p(n) and got["log_words"] == np.log1p(len(words)) and got["word_length"] == n / len(words)
    assert got["distinct_words"] == len(set(words)) / len(words)
    pairs = list(zip(words, words[1:]))
    assert got["distinct_pairs"] == len(set(pairs)) / len(pairs) and got["adjacent_repeats"] == sum(a == b for a, b in pairs) / len(pairs)
    assert got["distinct_lines"] == 3 / 4 and got["line_words"] == len(words) / 4
    assert quality.statistics(b"") == [0.0] * len(quality.STATISTICS) and len(quality.statistics(b"x" * 10**6)) == len(quality.STATISTICS)


def test_one_boosting_step_equals_brute_force():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (200, 3)).astype(float)
    y = ((x[:, 1] > 5) ^ (rng.random(200) < 0.1)).astype(float)
    forest = quality.fit(x, y, trees=1, depth=1, rate=0.15, least=1.0, ridge=2.0)
    p = y.mean()
    g, h = y - p, np.full(200, p * (1 - p))

    def gain(j, cut):
        left = x[:, j] <= cut
        if h[left].sum() < 1 or h[~left].sum() < 1:
            return -np.inf
        return sum(g[m].sum() ** 2 / (h[m].sum() + 2.0) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 2.0)

    best = max(gain(j, cut) for j in range(3) for cut in range(12))
    j, cut = forest.feature[0, 0], forest.split[0, 0]
    assert gain(j, cut) == pytest.approx(best)
    left = x[:, j] <= cut
    assert forest.value[0].tolist() == pytest.approx([0.15 * g[m].sum() / (h[m].sum() + 2.0) for m in (left, ~left)])


def labelled_docs(spark, n=600):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("the of and with from plain".split()) + str(rng.randint(0, 99)) for _ in range(60)]
        toxic, junk = i % 5 == 1, i % 4 == 1
        if toxic:
            words[rng.randrange(60)] = "worthless"
        text = " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words)
        rows.append((i, text, "s"))
        labels.append((i, 0 if junk else 1, int(toxic), "extra"))
    rows += [(n, None, "s"), (n + 1, "", "s"), (None, "plain1 words", None)]
    labels += [(None, 1, 1, "x"), (3, None, None, "x"), (3, 1, 0, "x")]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_classifiers(spark):
    docs, labels = labelled_docs(spark)
    model = toxicity.train(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    assert all((scores[i] >= 0.5) == (i % 5 == 1) for i in range(600))
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i in range(602) if i % 5 != 1 or i >= 600}
    forest = quality.train(docs, labels)
    good = {r.doc_id: r.score for r in quality.score_texts(docs, forest).collect()}
    assert all((good[i] >= 0.7) == (i % 4 != 1) for i in range(600))
    assert all(0 <= x <= 1 for x in [*scores.values(), *good.values()]) and len(good) == 603
    nothing = labels.limit(0)
    assert toxicity.drop_toxic(docs, toxicity.train(docs, nothing)).count() == 603
    assert quality.score_texts(docs.limit(0), quality.train(docs, nothing)).count() == 0


def test_held_out_rows_are_not_learned(spark):
    docs, labels = labelled_docs(spark, 100)
    ids = {r.id for r in labelled.labelled_sample(docs, labels, "toxic", 5, 0, 1000).collect()}
    assert ids and all(zlib.crc32(str(i).encode()) % 5 != 0 for i in ids)
    assert labelled.labelled_sample(docs, labels, "toxic", 5, 0, 10).count() <= 10


def test_forest_walk_equals_a_plain_walk():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(500, 6)), rng.integers(0, 2, 500).astype(float)
    forest = quality.fit(x, y, trees=7, depth=3)
    z = np.full(500, forest.base)
    for feature, split, value in zip(forest.feature, forest.split, forest.value):
        for i in range(500):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[i, feature[node]] > split[node])
            z[i] += value[node - len(feature)]
    assert np.allclose(forest.score(x), 1 / (1 + np.exp(-z)))


def test_intermediates_use_the_named_folder(spark):
    assert storage.fresh_path(spark, "x").startswith(storage.shared_dir(spark))
    assert storage.stored(spark.range(3).where(F.col("id") < 0), "none").count() == 0


def test_index_files_hold_few_segments(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c d"), F.col("id").cast("string")).alias("text")).coalesce(1)
    index = decontam.build_index(docs, str(tmp_path / "index"), segment_words=12)
    rows = [pq.ParquetFile(path).metadata.num_rows for path in (tmp_path / "index").glob("*.parquet")]
    assert sum(rows) == index.count() > 3 * decontam.FILE_SEGMENTS and max(rows) <= decontam.FILE_SEGMENTS
    items = spark.createDataFrame([("i", "c d 77")], "item_id string, text string")
    assert [r.doc_id for r in decontam.search(index, items).where("n_hit > 0").collect()] == [77]
