"""The naming operators on hand-traced names and against a sequential model of the clustering rules."""

import os
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from namelattice.config import Config
from namelattice.functions import text
from namelattice.functions.jaro import jaro_winkler
from namelattice.operators import catalog, clusters, components, labelling, scoring, semantics, similarity, tree, vocabulary
from namelattice.plans.pipeline import Run, training_lines
from namelattice.sources import points as sources
from namelattice.sources import sinks

F1 = ["AHU01/MAT", "AHU01/RAT", "AHU01/SAT", "AHU02/MAT", "AHU02/RAT", "AHU02/SAT"]


def names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "point_name string")


def test_uncamel_and_tokens(spark):
    cases = {
        "AHUTemp": "AHUT EMP", "zoneTempSP": "ZONE TEMP SP", "zoneT": "ZONET", "aBcd": "ABCD", "AABb": "AAB B", "roomSetPointX": "ROOM SET POINTX",
        "OAT": "O", "ab": "AB", "": "", "a": "A", "éA": "ÉA",
    }
    rows = names(spark, cases).select("point_name", text.uncamel(F.col("point_name")).alias("w"), text.uncamel(F.col("point_name"), "fixed").alias("f")).collect()
    assert {r.point_name: r.w for r in rows} == cases
    assert {r.f for r in rows if r.point_name == "OAT"} == {"OAT"}
    got = names(spark, ["AHU01/SAT", "room_1-a.B:c#d", "//", "a\t/ b", "SET  POINT"]).select(text.tokens(F.col("point_name")).alias("t")).collect()
    assert [r.t for r in got] == [["AHU01", "SAT"], ["ROOM", "1", "A", "B", "CD"], [], ["A", "B"], ["SET", "POINT"]]


def test_splits(spark):
    rows = names(spark, ["AHU01", "01", "AHU", "A1B22", "#", "É9"]).select("point_name", text.split_trailing(F.col("point_name")).alias("a"), text.split_runs(F.col("point_name")).alias("b")).collect()
    assert {r.point_name: (r.a, r.b) for r in rows} == {
        "AHU01": (["AHU", "01"], ["AHU", "01"]), "01": (["01"], ["01"]), "AHU": (["AHU"], ["AHU"]),
        "A1B22": (["A1B", "22"], ["A", "1", "B", "22"]), "#": (["#"], []), "É9": (["É", "9"], ["É", "9"]),
    }


def test_vocabulary_falls_apart(spark):
    table = spark.createDataFrame([(t,) for t in ["A1B1", "101", "1012", "AHU", "AHU7X", "X", "%%", "BAHU"]], "token string")
    got = {r.token: (r.children, r.leaves) for r in vocabulary.decomposed(table).collect()}
    assert got["A1B1"] == (["A1B", "1", "A", "B"], ["A", "1", "B", "1", "A", "B"])
    assert got["1012"] == (["2"], ["2"])
    assert got["AHU7X"][1] == ["AHU", "7", "X"] and got["AHU"] == ([], ["AHU"])
    assert got["%%"] == ([], ["%%"]) and got["BAHU"] == ([], ["BAHU"])


def test_tokens_inside_others_equal_brute_force(spark):
    rng = random.Random(5)
    words = {"".join(rng.choices("AB1é", k=rng.randint(1, 12))) for _ in range(400)} | {"AAAAAAA", "URL" + "X" * 3000 + "AAAAAAA7", "", "😀A1B"}
    table = spark.createDataFrame([(w,) for w in sorted(words)], "token string")
    got = sorted((r.token, r.piece) for r in vocabulary.inside(table, table).collect())
    assert got == sorted((w, x) for w in words if len(w) >= 4 for x in words if len(x) >= 3 and x != w and x in w)


def parts_beside(inner, outer):
    pieces = outer.split(inner)
    found = [re.match("([0-9]+)([A-Z]+)?", piece) for piece in pieces] if len(pieces) == 2 else []
    return [part for match in found if match for part in match.groups() if part]


def sequential_follow(words):
    """One pass over the vocabulary in order, as the rule is stated."""
    ordered = sorted(words, key=lambda t: (len(t), t))
    used, parts = set(), {}
    for i, inner in enumerate(ordered):
        if len(inner) < 3 or inner in used:
            continue
        for outer in ordered[i + 1 :]:
            if outer not in used and (found := parts_beside(inner, outer)):
                used.add(outer)
                parts[outer] = found
    return parts


def trailing(token):
    found = re.fullmatch("(?s)(.*?)([0-9]+)", token)
    return [found[1], found[2]] if found and found[1] else [token]


def sequential_fall(raw):
    """Passes over a vocabulary with counts: children in order, and each token's frequency in the end, long tokens first."""
    tokens, yielded = dict.fromkeys(raw), []

    def split(parts_of):
        for token, parts in parts_of:
            for part in parts:
                tokens.setdefault(part)
                yielded.append((token, part))

    split([(t, trailing(t)) for t in list(tokens)])
    split([(t, re.findall(r"[^\W\d_]+|\d+", t)) for t in list(tokens)])
    for _ in range(2):
        split(list(sequential_follow(tokens).items()))
    split([(t, trailing(t)) for t in list(tokens)])
    children = {t: [p for p in dict.fromkeys(p for s, p in yielded if s == t) if p != t] for t in tokens}
    count = {t: raw.get(t, 0) + sum(p == t for _, p in yielded) for t in tokens}
    for t in sorted(tokens, key=len, reverse=True):
        for part in children[t]:
            count[part] += count[t] - 1
    return children, count


def leaves_of(children, token):
    return [leaf for child in children[token] for leaf in leaves_of(children, child)] if children[token] else [token]


@pytest.mark.parametrize("seed", [3, 4])
def test_following_tokens_equal_sequential_passes(spark, seed):
    rng = random.Random(seed)
    raw = {"".join(rng.choices("AB01", k=rng.randint(1, 8))): rng.randint(1, 9) for _ in range(250)}
    raw |= {"%%": 2, "A%1": 1, "É9": 3, "X" * 5000 + "7" + "AHU" + "12B": 4, "AHU": 5, "12B34": 1}
    children, count = sequential_fall(raw)
    table = spark.createDataFrame([(t, n) for t, n in raw.items()], "token string, frequency long")
    fallen = vocabulary.fall(table)
    got = {r.token: (r.children, r.leaves) for r in vocabulary.decomposed(table, fallen).collect()}
    assert got == {t: (children[t], leaves_of(children, t)) for t in children}
    after = {r.token: (r.frequency, r.frequency_after) for r in vocabulary.frequency_after(table, fallen).collect()}
    assert after == {t: (raw.get(t), count[t]) for t in children}
    assert vocabulary.frequency_after(table.limit(0)).count() == 0


def test_long_tokens_fall_apart_in_linear_time(spark):
    """A token of 10,000 characters, with many tokens of the vocabulary inside it, has rows in proportion to its length."""
    rng = random.Random(9)
    long = "".join(rng.choices("ABCDEFGHIJKLMNOPQRST", k=10_000)) + "1"
    table = spark.createDataFrame([(long, 1), *((long[i : i + 9], 1) for i in range(0, 9_000, 30))], "token string, frequency long").distinct()
    assert vocabulary.inside(table.where(F.length("token") > 9), table).count() == 300
    got = {r.token: r.children for r in vocabulary.decomposed(table).collect()}
    assert got[long] == [long[:-1], "1"]


def test_numbers_meet_few_others(spark):
    # Of runs of three digits there are a thousand, so each of these numbers would meet some dozens of others.
    numbers = spark.range(4000).select(F.format_string("%06d", (F.col("id") * 7919) % 1000000).alias("token"))
    words = numbers.unionByName(numbers.select(F.concat(F.lit("AHUX"), "token").alias("token")))
    assert vocabulary.meeting(words, words).count() <= 2 * words.count()
    assert vocabulary.inside(words, words).count() == 4000


def test_jaro_winkler():
    assert jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111111)
    assert jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.813333333)
    assert jaro_winkler("AB", "XB") == pytest.approx(2 / 3) and jaro_winkler("", "A") == 0 and jaro_winkler("A", "A") == 1


def test_match_scores():
    assert scoring.match_score(["MAT"], ["MAT"]) == 1.0 and scoring.match_score([], ["MAT"]) == 0.0
    assert scoring.match_score(["MA", "T"], ["MAT"]) == pytest.approx(1.0)
    assert scoring.match_score(["ZN", "TEMP", "X"], ["ZN", "TEMP"]) == pytest.approx(2 / 3)


def test_hand_traced_run(spark):
    run = Run(names(spark, F1), Config(uncamel="truncate"))
    assert {(r.point_name, tuple(r.path)) for r in run.paths.collect()} == {(n, ("AHU", n[3:5], n[6:])) for n in F1}
    assert {r.metric: r.value for r in run.report().collect()} == {"nodes": 9, "leaves": 6, "types": 6, "explained": 6, "unexplained": 0, "unique_points": 3, "concepts": 1}
    assert [tuple(r) for r in run.similar.collect()] == [("AHU01", "AHU02", 3, 3, 3)]
    concept = run.found.concepts.first()
    assert concept.members == ["MAT", "RAT", "SAT"] and {r.node_id for r in run.found.membership.collect()} == {"AHU01", "AHU02"}
    assert run.concept_names.first()["name"] == "AHU_MAT_" and run.edges.count() == 0
    best = run.resolved().collect()
    assert {(r.original_point, r.equipment, r.node, r.distance, r.representation) for r in best} == {(n, "UNKNOWN", n[:5], 0.0, "UNKNOWN") for n in F1}


def test_given_class_labels_points(spark):
    run = Run(names(spark, F1))
    classes = run.found.concepts.select("concept_id", F.lit("AHU").alias("class_label"))
    got = {tuple(r.rel_path): (r.label, round(r.score, 9)) for r in labelling.assigned_labels(run.prepared, classes).collect()}
    assert got == {("MAT",): ("MixedAirTemp(AHU)", 1.0), ("RAT",): ("ReturnAirTemp(AHU)", 1.0), ("SAT",): ("OutdoorAirTemp(AHU)", round(7 / 9, 9))}
    over = {tuple(r.rel_path): (r.label, r.score) for r in labelling.assigned_labels(run.prepared, classes, Config(overflow="overwrite")).collect()}
    assert over[("MAT",)] == ("Humidity(AHU)", -1.0)


def test_node_ids_may_collide_or_not(spark):
    paths = spark.createDataFrame([("p1", ["A", "BC"]), ("p2", ["AB", "C"])], "point_name string, path array<string>")
    assert {r.node_id for r in tree.nodes(paths).collect()} == {"A", "ABC", "AB"}
    assert tree.nodes(paths, "path").count() == 4
    assert [(r.leaf_id, r.point_name, r.n_points) for r in tree.leaves(paths).collect()] == [("ABC", "p1", 2)]


def alike(a, b, ratio):
    most, least = max(len(a), len(b)), min(len(a), len(b))
    return least >= 2 and (most == least or most - least < least * (1.0 - ratio)) and len(a & b) / most >= ratio


def sequential_concepts(rows, ratio):
    """Nodes in order; a node not yet placed is linked to all alike nodes, and linked clusters merge."""
    place, group = {}, {}
    for i, (node, a) in enumerate(rows):
        if node in place:
            continue
        for other, b in rows:
            if other != node and alike(set(a), set(b), ratio):
                for x in (node, other):
                    if x not in place:
                        place[x] = x
                        group[x] = {x}
                keep, lose = place[node], place[other]
                if keep != lose:
                    for x in group.pop(lose):
                        place[x] = keep
                        group[keep].add(x)
    return {frozenset(g) for g in group.values()}


def sequential_refine(rows, groups, ratio, existing):
    members = dict(rows)
    order = {node: i for i, (node, _) in enumerate(rows)}
    out = []
    for group in groups:
        left = set(group)
        seen = set()
        for node in sorted(group, key=order.get):
            if node in seen:
                continue
            seen.add(node)
            taken = [o for o in sorted(group, key=order.get) if o not in seen and alike(set(members[node]), set(members[o]), ratio)]
            seen |= set(taken)
            if taken and frozenset(members[node]) not in existing:
                out.append(frozenset([node, *taken]))
                left -= {node, *taken}
        if left:
            out.append(frozenset(left))
    return set(out)


def random_forest(rng):
    kinds = [rng.sample("abcdefghijkl", rng.randint(2, 9)) for _ in range(5)]
    found = []
    for unit in range(26):
        kids = list(rng.choice(kinds))
        for _ in range(rng.randint(0, 2)):
            if rng.random() < 0.5 and len(kids) > 2:
                kids.remove(rng.choice(kids))
            else:
                kids.append(rng.choice("mnopqr"))
        found += [f"u{unit:02d}x/{k}{k}{k}z" for k in dict.fromkeys(kids)]
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_concepts_equal_the_sequential_rules(spark, seed):
    values = random_forest(random.Random(seed))
    run = Run(names(spark, values).repartition(5), Config(similarity=0.6, refinement=0.9))
    order = {r.node_id: (r.first_point, r.depth) for r in run.tree.collect()}
    rows = sorted(((r.node_id, list(r.members)) for r in run.members.collect()), key=lambda x: order[x[0]])
    first = clusters.find_concepts(run.tree, run.members, 0.6)

    def groups(found):
        out = {}
        for r in found.membership.collect():
            out.setdefault(r.concept_id, set()).add(r.node_id)
        return {frozenset(g) for g in out.values()}

    expected = sequential_concepts(rows, 0.6)
    assert groups(first) == expected and len(expected) > 1
    existing = {frozenset(r.members) for r in first.concepts.collect()}
    assert groups(run.found) == sequential_refine(rows, expected, 0.9, existing)
    pairs = {(a, b) for i, (a, x) in enumerate(rows) for b, y in rows if a < b and alike(set(x), set(y), 0.6)}
    assert {(r.node_a, r.node_b) for r in similarity.similar_nodes(run.tree, run.members, 0.6).collect()} == pairs


def test_nodes_of_one_set_are_paired_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "NODES_A_BLOCK", 50, raising=False)
    run = Run(names(spark, [f"U{i:04d}/{c}" for i in range(700) for c in ("MAT", "RAT", "SAT")] + [f"W{i:02d}/{c}" for i in range(40) for c in ("MAT", "RAT", "SAT", "XTR")]))
    found = similarity.similar_nodes(run.tree, run.members, 0.6).withColumn("task", F.spark_partition_id())
    sets = {r.node_id: set(r.members) for r in run.members.where("size >= 2").collect()}
    got = [(r.node_a, r.node_b, r.overlap, r.size_a, r.size_b) for r in found.collect()]
    expected = [(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and alike(sets[a], sets[b], 0.6)]
    assert sorted(got) == sorted(expected) and len(got) > 270_000
    # No task has more than half of what one set of 700 equal nodes gives.
    rows = [r["count"] for r in found.groupBy("task").count().collect()]
    assert len(rows) > 2 and max(rows) < len(got) / 2


def test_pairs_are_written_out_a_few_nodes_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(similarity, "NODES_A_BLOCK", 9)
    rng = random.Random(6)
    kinds = [("MAT", "RAT", "SAT"), ("MAT", "RAT", "SAT", "XTR"), ("FAN", "PMP")]
    run = Run(names(spark, [f"U{i:04d}/{c}" for i in range(120) for c in rng.choice(kinds)]))
    found = similarity.similar_nodes(run.tree, run.members, 0.6)
    sets = {r.node_id: set(r.members) for r in run.members.where("size >= 2").collect()}
    expected = [(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and alike(sets[a], sets[b], 0.6)]
    assert sorted(map(tuple, found.collect())) == sorted(expected) and len({e[2:] for e in expected}) == 5
    # The code that writes a block's pairs out takes its rows from other code, or it would hold a block squared.
    steps = [line for line in found._jdf.queryExecution().toString().split("Physical Plan")[1].splitlines() if "Generate" in line or "Coalesce " in line]
    assert ["Generate" in step for step in steps[:4]] == [True, True, False, True]


def test_clean_up_cuts_like_children(spark):
    # A unit's sixth child repeats five of its children: alike enough to be cut off, too unlike to be one concept with it.
    kids = "abcdef"
    values = [f"top{t}/{k * 4}" for t in "pq" for k in kids[:5]] + [f"top{t}/{'f' * 4}/{k * 4}" for t in "pq" for k in kids[:5]]
    run = Run(names(spark, values))
    cut, after = run.cleaned
    assert {tuple(r) for r in cut.collect()} == {("TOPP", "TOPPFFFF"), ("TOPQ", "TOPQFFFF")}
    assert sorted(sorted(r.members) for r in after.collect()) == [[k * 4 for k in "ABCDE"], [k * 4 for k in "ABCDE"]]
    assert tree.closure(run.tree, cut).where("ancestor = 'TOPP'").count() == 5 and tree.closure(run.tree).where("ancestor = 'TOPP'").count() == 11


def test_cuts_in_rounds_equal_a_walk_in_order(spark):
    rng = random.Random(12)
    rows = []
    for c in range(60):
        members = rng.sample("ABCDEFGHIJKL", rng.randint(3, 12))
        for i in range(rng.randint(0, 14)):
            child = [m for m in members if rng.random() < 0.85] + rng.sample("XYZ", rng.randint(0, 2))
            rows.append((f"c{c}", rng.choice([*members, "Q"]), f"k{i}", rng.choice("pqr"), rng.randint(1, 2), members, child))
    expected = set()
    for c in {r[0] for r in rows}:
        left = list(next(r for r in rows if r[0] == c)[5])
        for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[3], r[4], r[1], r[2])):
            if len(set(r[6])) > 1 and len(left) > 4 and len(set(left) & set(r[6])) >= (len(left) - 1) * 0.8:
                expected.add(r[:3])
                left = [m for m in left if m != r[1]]
    table = spark.createDataFrame(rows, "concept_id string, token string, child_concept string, first_point string, depth int, members array<string>, child_members array<string>").repartition(3)
    got = [tuple(r) for r in clusters.child_cuts(table).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 60
    assert clusters.child_cuts(table.limit(0)).count() == 0


def test_sorted_vocabulary(spark):
    words = spark.createDataFrame([("B", 1, 3), ("A", 1, 3), ("AAA", 3, 1), ("CC", 2, 9)], "token string, size long, frequency long")
    assert [r.token for r in vocabulary.by_frequency(words).collect()] == ["CC", "A", "B", "AAA"]
    assert [r.token for r in vocabulary.by_size(words).collect()] == ["A", "B", "CC", "AAA"]


def test_closure_of_a_deep_walk(spark):
    deep = [f"t{chr(97 + i)}{chr(97 + i)}" + "q" * 3 for i in range(21)]
    run = Run(names(spark, ["/".join(deep), "/".join(deep[:4])]))
    rows = tree.closure(run.tree).collect()
    assert len(rows) == 21 * 20 // 2 and max(r.distance for r in rows) == 20
    assert all(len(r.rel_path) == r.distance and r.node_id == r.ancestor + "".join(r.rel_path) for r in rows)
    assert tree.closure(run.tree.limit(0)).count() == 0


def test_ways_up_of_inner_nodes_suffice_for_associations(spark):
    run = Run(names(spark, F1 + ["B/C/D/E/F/GG1", "B/C/D/E/F/HH"]))
    run.edges.count()
    assert "closure" not in vars(run)
    parents = {r.parent_id for r in run.tree.collect()}
    above = lambda rows: {(r.node_id, r.ancestor, r.distance, *r.rel_path) for r in rows.collect()}
    assert above(tree.inner_closure(run.inner_chains)) == {row for row in above(run.closure) if row[0] in parents}
    rows = above(run.closure)
    assert all(row[0] == row[1] + "".join(row[3:]) for row in rows) and len(rows) == sum(r.depth - 1 for r in run.tree.collect())


def test_seeds_in_rounds_and_at_once(spark):
    rng = random.Random(4)
    order = rng.sample(range(60), 60)
    sets = spark.createDataFrame([(f"s{i:02d}", (f"p{order[i]:02d}", 1)) for i in range(60)], "set_id string, ord struct<first_point:string,depth:int>")
    links = {tuple(sorted(rng.sample(range(50), 2))) for _ in range(70)} | {(i, i + 1) for i in range(30, 49)}
    pairs = spark.createDataFrame([(f"s{a:02d}", f"s{b:02d}") for a, b in links], "a string, b string")
    expected = set()
    for i in sorted(range(60), key=lambda i: order[i]):
        if not any((min(i, j), max(i, j)) in links for j in expected):
            expected.add(i)
    for few in (0, 5, 1000):
        assert {r.set_id for r in clusters.seeds(sets, pairs, few).collect()} == {f"s{i:02d}" for i in expected}


def test_base_classes_take_over_nodes(spark):
    tree_rows = [("a", "ALPHA", None, 1, "p1"), ("b", "BETA", None, 1, "p2"), ("c", "7", None, 1, "p3"), ("d", "BETA", None, 1, "p4"), ("e", "GAMMA", None, 1, "p5")]
    nodes = spark.createDataFrame(tree_rows, "node_id string, token string, parent_id string, depth int, first_point string")
    members = spark.createDataFrame([("a", ["X"], 1), ("b", ["Y"], 1), ("c", ["Z"], 1), ("d", ["X"], 1), ("e", ["8"], 1)], "node_id string, members array<string>, size int")
    membership = spark.createDataFrame([("one", n) for n in "abcde"] + [("two", "f")], "concept_id string, node_id string")
    classes, edges, moves = semantics.simple_bases(nodes, members, membership)
    got = {r.concept_id: tuple(r.members) for r in classes.collect()}
    # The base has the child of the last node whose child is no number: d's X.
    assert set(got.values()) == {("X",), ("ALPHA", "X"), ("BETA", "Y")}
    assert {(got[r.src], got[r.dst]) for r in edges.collect()} == {(("X",), ("ALPHA", "X")), (("X",), ("BETA", "Y"))}
    assert {r.node_id: got[r.concept_id] for r in moves.collect()} == {"a": ("ALPHA", "X"), "b": ("BETA", "Y"), "d": ("BETA", "Y")}
    concepts = spark.createDataFrame([("one", ["X"], ("p1", 1)), ("two", ["Q", "R"], ("p9", 1)), ("three", ["S"], ("p9", 2))], "concept_id string, members array<string>, ord struct<first_point:string,depth:int>")
    found = clusters.with_base_classes(clusters.Concepts(concepts, membership), classes, moves)
    assert {r.concept_id for r in found.concepts.collect()} == {"one", "two", "three", *got}
    assert {(r.concept_id, r.node_id) for r in found.membership.collect()} >= {("one", "c"), ("one", "e"), ("two", "f")} and found.membership.count() == 6
    whole = clusters.with_base_classes(clusters.Concepts(concepts, membership.where("node_id not in ('c', 'e')")), classes, moves)
    assert {r.concept_id for r in whole.concepts.collect()} == {"two", "three", *got}


def test_derivations_in_the_graph(spark):
    concepts = spark.createDataFrame([("a", ["u", "v", "w"]), ("b", ["u", "v", "w", "x"]), ("c", ["u", "v", "w", "y"]), ("d", ["k", "l"])], "concept_id string, members array<string>")
    edges = spark.createDataFrame([("b", "d", "association"), ("a", "d", "association"), ("c", "d", "association"), ("z", "b", "derivation"), ("z", "c", "derivation"), ("b", "z", "derivation")], "src string, dst string, edge_type string")
    assert {tuple(r) for r in semantics.siblings(edges).collect()} == {("b", "c"), ("c", "b")}
    assert {tuple(r) for r in semantics.relatives(edges).collect()} == {("z", "b"), ("b", "z")}
    found, bases = semantics.derivations(concepts, edges)
    assert {(r.src, r.dst) for r in found.collect()} == {("a", "b"), ("a", "c")} and bases.count() == 0  # b and c have one base already
    alone, more = semantics.derivations(concepts.where("concept_id in ('b', 'c')"), edges.limit(0))
    assert alone.count() == 2 and [sorted(r.members) for r in more.collect()] == [["u", "v", "w"]]
    after = {tuple(r) for r in semantics.with_derivations(edges, found).collect()}
    assert ("a", "d", "association") in after and ("b", "d", "association") not in after and ("c", "d", "association") not in after and ("a", "b", "derivation") in after
    names_ = spark.createDataFrame([("d", "w")], "concept_id string, name string")
    start = edges.where("src = 'b' and dst = 'd'")
    moved = {tuple(r) for r in semantics.with_derivations(start, found, concepts, names_).collect()}
    assert moved == {("a", "b", "derivation"), ("a", "c", "derivation"), ("a", "d", "association")}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    starts = spark.createDataFrame([("a", "u"), ("b", "x"), ("d", "k"), ("d", "none")], "concept_id string, token string")
    assert {tuple(r) for r in semantics.base_with_member(concepts, ring, starts).collect()} == {("a", "u", "c"), ("b", "x", "b"), ("d", "k", "d")}
    said = semantics.base_report(concepts, found, spark.createDataFrame([("b", "n1"), ("b", "n2")], "concept_id string, node_id string"), concepts.select("concept_id", F.upper("concept_id").alias("name")), concepts.select("concept_id", F.lit("VAV").alias("class_label")))
    assert {(r.base_id, r.value) for r in said.collect()} == {("a", "derived class B label VAV id b instances 2"), ("a", "derived class C label VAV id c instances 0")}


def test_relations_meet_over_rare_members_only(spark):
    rng = random.Random(7)
    sets = [sorted(rng.sample("abcdefghij", rng.randint(1, 7))) for _ in range(40)]
    concepts = spark.createDataFrame([(f"c{i:02d}", m) for i, m in enumerate({tuple(s): s for s in sets}.values())], "concept_id string, members array<string>")
    rows = {r.concept_id: set(r.members) for r in concepts.collect()}
    none = spark.createDataFrame([], "src string, dst string, edge_type string")
    edges, _ = semantics.derivations(concepts, none, 0.5, 0.7)
    direct = {(r.src, r.dst) for r in edges.collect() if r.src in rows}
    expected = {(a, b) for a, x in rows.items() for b, y in rows.items() if len(x) > 2 and x < y}
    assert expected and expected <= direct
    assert all((a, b) in expected or len(rows[a] & rows[b]) >= 0.7 * max(len(rows[a]), len(rows[b])) for a, b in direct)
    members = concepts.select(F.col("concept_id").alias("node_id"), "members", F.size("members").alias("size"))
    for ratio in (0.5, 0.6, 0.9):
        fits = lambda a, b: a == b or max(a, b) - min(a, b) < min(a, b) * (1.0 - ratio)
        pairs = {(a, b, len(x & y)) for a, x in rows.items() for b, y in rows.items() if a != b and min(len(x), len(y)) >= 2 and fits(len(x), len(y)) and len(x & y) / len(x) >= ratio}
        assert {tuple(r) for r in similarity.similar_asymmetric(members, ratio).collect()} == pairs


def sequential_labels(points, model, overflow):
    """Scores of all points and labels; the best free pair again and again, the first label and point of equals."""
    free_labels, free_points, out = list(model), list(range(len(points))), {}
    while free_labels:
        if not free_points and overflow == "stop":
            break
        scored = [(scoring.best_score(points[p], model[label]) if p in free_points else -1.0, label, p) for label in free_labels for p in range(len(points))]
        best = max(x[0] for x in scored)
        _, label, point = next(x for x in scored if x[0] == best)
        out[point] = (label, best)
        free_labels.remove(label)
        free_points = [p for p in free_points if p != point]
    return out


@pytest.mark.parametrize("overflow", ["stop", "overwrite"])
def test_labels_equal_a_sequential_assignment(spark, overflow):
    rng = random.Random(11)
    words = "ZN T TEMP SP SET OCC HUM RH ROOM POS DMP VAV AIR OAT X1 FOO".split()
    rows, expected = [], set()
    for c, equip in enumerate(("VAV", "AHU", "VRF", "VAV")):
        points = sorted({tuple(rng.choices(words, k=rng.randint(1, 3))) for _ in range(rng.choice([3, 9]))})
        rows += [(f"c{c}", list(p), list(p)) for p in points]
        model = catalog.point_model("flat")[equip]
        expected |= {(f"c{c}", points[i], label, round(score, 9)) for i, (label, score) in sequential_labels([list(p) for p in points], model, overflow).items()}
    table = spark.createDataFrame(rows, "concept_id string, rel_path array<string>, tokens array<string>").repartition(3)
    classes = spark.createDataFrame([("c0", "VAV"), ("c1", "AHU"), ("c2", "VRF"), ("c3", "VAV")], "concept_id string, class_label string")
    got = labelling.assigned_labels(table, classes, Config(catalog_merge="flat", overflow=overflow)).collect()
    assert {(r.concept_id, tuple(r.rel_path), r.label, round(r.score, 9)) for r in got} == expected


def test_candidates_by_hand(spark):
    leaves = spark.createDataFrame([("l1", "p1"), ("l2", "p2")], "leaf_id string, point_name string")
    closure = spark.createDataFrame([("l1", "n1", 1, ["T"]), ("l1", "n2", 2, ["N", "T"]), ("l1", "n3", 3, ["M", "N", "T"]), ("l1", "n4", 4, ["K"]), ("l2", "n2", 1, ["Q"]), ("l2", "n5", 2, ["R"])], "node_id string, ancestor string, distance int, rel_path array<string>")
    membership = spark.createDataFrame([("c1", "n1"), ("c2", "n2"), ("c3", "n3"), ("c4", "n4"), ("c5", "n5")], "concept_id string, node_id string")
    classes = spark.createDataFrame([("c1", "VAV"), ("c2", "AHU"), ("c3", "VAV"), ("c4", "COLLECTION"), ("c5", "nnnn")], "concept_id string, class_label string")
    points = spark.createDataFrame([("c1", ["T"], "ZoneTemp(VAV)", 0.4, "p1"), ("c2", ["N", "T"], "Humidity(AHU)", 0.9, "p1"), ("c4", ["K"], "X", 0.7, "p1")], "concept_id string, rel_path array<string>, label string, score double, point_name string")

    def listed(**options):
        rows = labelling.candidates(leaves, closure, membership, classes, points, **options)
        return {r.point_name: [(c["class"], c.node, c.label, c.score) for c in r.cands] for r in rows.collect()}, labelling.resolved(rows).collect()

    found, best = listed()
    # One candidate a class, the nearest; a collection has no label and no score; a skipped class is no candidate.
    assert found == {"p1": [("VAV", "n1", "ZoneTemp(VAV)", 0.4), ("AHU", "n2", "Humidity(AHU)", 0.9), ("COLLECTION", "n4", None, None)], "p2": [("AHU", "n2", "UNKNOWN", 0.0)]}
    assert {(r.original_point, r.equipment, r.node, r.distance) for r in best} == {("p1", "AHU", "n2", 0.9), ("p2", "AHU", "n2", 0.0)}
    assert listed(limit=0.5)[0] == {"p1": [("AHU", "n2", "Humidity(AHU)", 0.9), ("COLLECTION", "n4", None, None)]}
    assert listed(drop_unknown=True)[0].keys() == {"p1"}


def test_set_relations(spark):
    rows = spark.createDataFrame([(["a", "b", "c", "d"], ["a", "b", "c"])], "x array<string>, y array<string>")
    x, y = F.col("x"), F.col("y")
    r = rows.select(semantics.is_derived(x, y).alias("d"), semantics.is_derived(y, x).alias("e"), semantics.generalizes(y, x, 0.7).alias("g"), semantics.generalizes(y, x, 0.8).alias("h"), semantics.common_members(x, y, 0.75).alias("c"), semantics.common_members(x, y, 0.8).alias("n")).first()
    assert tuple(r) == (True, False, True, False, ["a", "b", "c"], [])


def test_components_in_the_library(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "a string, b string")
    assert {r.component for r in components.connected_components(edges).collect()} == {"0"}


def test_revised_classes(spark):
    concepts = spark.createDataFrame([(c,) for c in "abcdefgh"], "concept_id string")
    own = spark.createDataFrame([("a", "AHU"), ("b", "VAV"), ("c", "VAV"), ("d", "AHU"), ("e", "AHU"), ("g", "VRF")], "concept_id string, class_label string")
    edges = spark.createDataFrame([("a", "b"), ("d", "e"), ("d", "f"), ("g", "g"), ("h", "c"), ("h", "d")], "src string, dst string").withColumn("edge_type", F.lit("association"))
    got = dict(labelling.concept_classes(concepts, edges, own).collect())
    assert got["a"] == "CONTAINER" and got["d"] == "AHU" and got["e"] == got["f"] == "UNKNOWN" and got["h"] == "COMPOSITE" and got["b"] == got["c"] == "VAV"


def reachable(links, start):
    """Nodes on walks of one link or more."""
    found, stack = set(), [start]
    while stack:
        for b in links.get(stack.pop(), ()):
            if b not in found:
                found.add(b)
                stack.append(b)
    return found


def plainly_revised(own, links):
    """Own classes revised by those of successors, links inside a cycle seen as UNKNOWN; what air handlers take goes last."""
    ahead = {a: reachable(links, a) for a in own}
    label, takes = {}, set()

    def revise(a):
        if a not in label:
            seen = {"UNKNOWN" if b == a or a in ahead[b] else revise(b) for b in links.get(a, ())}
            if len(seen) == 1 and seen != {"UNKNOWN"}:
                label[a] = "CONTAINER"
            elif seen in ({"AHU", "UNKNOWN"}, {"VRF", "UNKNOWN"}):
                label[a] = own[a]
                takes.update([a] if own[a] == "AHU" else [])
            else:
                label[a] = "COMPOSITE" if len(seen) > 1 and seen & {"AHU", "VAV", "VRF"} else own[a]
        return label[a]

    for a in own:
        revise(a)
    return label | {b: "UNKNOWN" for a in takes for b in links[a] if b != a}


@pytest.mark.parametrize("seed", [1, 5])
def test_classes_are_revised_level_by_level(spark, seed):
    rng = random.Random(seed)
    names = [f"c{i:02d}" for i in range(45)]
    own = {c: rng.choice(["AHU", "AHU", "VAV", "VRF", "UNKNOWN"]) for c in names}
    pairs = {(a, b) for a, b in zip(names, names[1:]) if rng.random() < 0.25} | {(names[i], names[min(44, i + rng.randint(1, 20))]) for i in range(44)}
    pairs |= {("c10", "c04"), ("c22", "c20"), ("c20", "c21"), ("c21", "c22"), ("c33", "c33"), ("c40", "c35")}
    links = {}
    for a, b in pairs:
        links.setdefault(a, set()).add(b)
    frames = spark.createDataFrame([(c,) for c in names], "concept_id string"), spark.createDataFrame([(a, b, "association") for a, b in pairs] + [("c05", "gone", "association"), ("c44", "c00", "derivation")], "src string, dst string, edge_type string")
    got = dict(labelling.concept_classes(*frames, spark.createDataFrame([(c, k) for c, k in own.items() if k != "UNKNOWN"], "concept_id string, class_label string")).collect())
    expected = plainly_revised(own, links)
    assert got == expected and {"AHU", "UNKNOWN", "COMPOSITE", "CONTAINER"} <= set(got.values())
    ahead = {a: reachable(links, a) for a in names}
    cycles = {a: min(b for b in names if b == a or (b in ahead[a] and a in ahead[b])) for a in names if any(b != a and a in ahead[b] for b in ahead[a])}
    from namelattice.operators import components

    assert dict(components.strongly_connected(spark.createDataFrame([*pairs, (None, "c01")], "a string, b string")).collect()) == cycles
    assert components.strongly_connected(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("cut", [0.82, 0.85, 0.95])
def test_alike_tokens_equal_brute_force(spark, cut):
    rng = random.Random(17)
    made = ["".join(rng.choices("ABCDE1é", k=rng.randint(1, 12))) for _ in range(150)]
    made += [w[:i] + rng.choice("ABX") + w[i + 1 :] for w in made[:80] for i in [rng.randrange(len(w))]] + ["", "😀A", "A😀", "Z" * 400, "ZONE", "ZN", "A" * 12, "AAAB"]
    left, right = made[::2] + ["ZONES"], made[1::2] + ["A", "ZONE"]
    tables = [spark.createDataFrame([(w,) for w in words], "token string").repartition(3) for words in (left, right)]
    found = scoring.alike_tokens(*tables, cut=cut)
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    got = {(r.token, r.alt_token) for r in found.collect()}
    expected = {(a, b) for a in left for b in right if jaro_winkler(a, b) > cut}
    assert got == expected and len(expected) > (30 if cut < 0.9 else 5)
    assert scoring.alike_tokens(tables[0], tables[1].limit(0)).count() == 0


def test_numbers_of_one_length_are_compared_without_a_shuffle_of_pairs(spark):
    numbers = [f"{n * 7919 % 100000:05d}" for n in range(1, 2501)]
    tokens = spark.createDataFrame([(n,) for n in numbers], "token string")
    found = scoring.alike_tokens(tokens, tokens, block=512)
    # Nearly all numbers share a frequent digit, so pairs must not be rows before they are known to be alike.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan.splitlines()[0] + plan.splitlines()[1] + plan.splitlines()[2] and "Aggregate" not in plan
    got = {(r.token, r.alt_token): r.similarity for r in found.collect()}
    expected = {(a, b): s for a in numbers[:100] for b in numbers if (s := jaro_winkler(a, b)) > scoring.TOKEN_CUT}
    assert {k: s for k, s in got.items() if k[0] in set(numbers[:100])} == expected and len(expected) > 200


def test_tokens_of_the_same_letters_are_compared_together(spark):
    rng = random.Random(3)
    words = [f"{rng.randrange(10**6)}{rng.choice(['', 'TOP', '?PAGE=2&REF=X'])}" for _ in range(400)] + ["".join(rng.sample("AABBCCDDEE", 10)) for _ in range(300)] + ["A" * 20 + "B" * 13, "A" * 19 + "B" * 14, "é😀", "😀é"]
    words = list(dict.fromkeys(words))
    tokens = spark.createDataFrame([(w,) for w in words], "token string")
    rows, n = scoring._blocks(tokens, "token", "tokens", 50)
    rows, homes = rows.collect(), {}
    for r in rows:
        for w in r.token:
            homes.setdefault("".join(sorted(w)), set()).add(r["at"])
    # One block for all orders of the same letters, but no row of all of them where they are many.
    assert n > 10 and all(len(h) == 1 for h in homes.values()) and max(len(r.token) for r in rows) < 200
    assert sorted(w for r in rows for w in r.token) == sorted(words)
    found = scoring.alike_tokens(tokens, tokens, block=50, digits=9)
    got = {(r.token, r.alt_token): r.similarity for r in found.collect()}
    expected = {(a, b): s for a in words for b in words if (s := jaro_winkler(a, b)) > scoring.TOKEN_CUT}
    assert got.keys() == expected.keys() and found.count() == len(expected) > 20_000
    values = spark.createDataFrame([(s,) for s in set(expected.values())], "s double").select("s", F.round("s", 9).alias("r"))
    rounded = dict(map(tuple, values.collect()))
    assert all(got[k] == rounded[s] for k, s in expected.items())


def test_a_catalogue_of_ones_own(spark, tmp_path):
    from namelattice.sources.catalogue import checked_model, read_catalogue

    (tmp_path / "c.json").write_text('{"equip":"PUMP","label":"Flow","alternatives":[["FLW"],["WATER","FLOW"]]}\n{"equip":"FAN","label":"Speed","alternatives":[["SPD"]]}\n')
    rows = read_catalogue(spark, str(tmp_path / "c.json"))
    model = checked_model(rows)
    assert model == {"FAN": {"Speed": [["SPD"]]}, "PUMP": {"Flow": [["FLW"], ["WATER", "FLOW"]]}}
    scores = scoring.label_scores(spark.createDataFrame([(["FLW"],), (["WATR", "FLOW"],)], "tokens array<string>"), model)
    best = {tuple(r.tokens): (r.equip, r.label) for r in scores.where("score > 0.9").collect()}
    assert best == {("FLW",): ("PUMP", "Flow"), ("WATR", "FLOW"): ("PUMP", "Flow")}
    with pytest.raises(ValueError, match="3 alternatives; 2 at most"):
        checked_model(rows, most=2)
    with pytest.raises(ValueError, match="twice in the catalogue: FAN Speed SPD"):
        checked_model(rows.unionByName(rows.where("equip = 'FAN'")))
    for bad in (None, [], ["A", None], [""]):
        with pytest.raises(ValueError, match="lack"):
            checked_model(rows.unionByName(spark.createDataFrame([("FAN", "Speed", bad)], "equip string, label string, alternative array<string>")))
    (tmp_path / "bad.json").write_text('{"equip":"FAN","label":"Speed","alternatives":"SPD"}\n')
    with pytest.raises(Exception):
        checked_model(read_catalogue(spark, str(tmp_path / "bad.json")))


def test_catalogue_modes():
    assert [len(x) for x in (catalog.class_labels(), catalog.point_labels())] == [4, 17]
    assert catalog.class_codes() == {"AHU": 1, "VAV": 2, "VRF": 3}
    nested, flat = catalog.point_model("nested"), catalog.point_model("flat")
    assert len(nested["AHU"]["Humidity(AHU)"]) == 6 and len(flat["AHU"]["Humidity(AHU)"]) == 9


def test_sources(spark, tmp_path):
    (tmp_path / "n.txt").write_text(" a/b \n\na,b\na/b\nx\n", encoding="utf-8")
    good, bad = sources.read_names(spark, str(tmp_path / "n.txt"))
    assert sorted(r.point_name for r in good.collect()) == ["a/b", "x"] and [r.value for r in bad.collect()] == ["a,b"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "k.json").write_text('{"CLASSES":[{"LABEL":"VAV","POINTS":[{"POINT":["Z","ZN","T"],"LABEL":"ZoneTemp(VAV)"},{"POINT":["Z","OCC"],"LABEL":"Occupancy(VAV)"}]}]}')
    found = sources.read_clusters(spark, str(tmp_path / "c"))
    assert {(r.point_key, r.point_label) for r in sources.cluster_truth(found).collect()} == {("Z,ZN,T", "ZoneTemp(VAV)"), ("Z,OCC", "Occupancy(VAV)")}
    assert {tuple(r.tokens) for r in sources.cluster_points(found).collect()} == {("ZN", "T"), ("OCC",)}
    line = training_lines(found).first().value.split("\t")
    assert line[0] == "2" and [x.split(":")[0] for x in line[1:]] == ["0", "1", "2"]
    points = spark.createDataFrame([("p", "t", 1, "o"), ("p", "t", 1, "o"), ("p", None, None, None)], "point_name string, object_type string, device_id int, object_id string")
    assert sources.distinct_points(points).count() == 2


def test_sinks(spark, tmp_path):
    run = Run(names(spark, F1))
    found = run.candidates()
    sinks.write_candidates(found, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 6
    sinks.write_candidates(found, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["pointName", "className", "clusterID", "label", "distance"]
    sinks.write_resolved(run.resolved(), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == ["OriginalPoint", "Equipment", "Node", "Distance", "Representation"]
    assert sinks.candidate_lines(found).first().value.startswith("AHU01/MAT,\tUNKNOWN,\tAHU01")
    first, second = sinks.instance_sections(run.found.concepts, run.found.membership, run.members, run.concept_names)
    assert (first.count(), second.count()) == (1, 2)
    assert '"POINT":["MAT"]' in sinks.cluster_json(run.concept_points, run.classes, run.found.membership).first().value
    dot = [r.value for r in sinks.dot_lines(run.concept_names, semantics.class_instances(run.found.membership), run.edges).orderBy("ord").collect()]
    assert dot[0].startswith("digraph") and dot[-1] == "}" and len(dot) == 3
    assert sinks.read_scaler(sinks.scaler_json([1.0], [2.0])) == ([1.0], [2.0])


def test_trained_classifier_and_plug_ins(spark, tmp_path):
    from namelattice.operators import classifier

    rows = [(f"{equip}{i}", e, o, (6.0 if e == equip else 1.0) + i * 0.1) for equip in ("AHU", "VAV", "VRF") for i in range(8) for o, e in enumerate(("AHU", "VAV", "VRF"))]
    vectors = spark.createDataFrame(rows, "concept_id string, equip string, equip_ord int, feature double")
    classes = vectors.select("concept_id", F.substring("concept_id", 1, 3).alias("class_label")).distinct()
    mean, std = classifier.fitted_scaler(vectors)
    model = classifier.train(vectors, classes, mean, std, iterations=8)
    sizes = classes.select("concept_id", F.when(F.col("concept_id") == "AHU0", 1).when(F.col("concept_id") == "AHU1", 151).otherwise(9).alias("n"))
    model.save(str(tmp_path / "device"))
    again = classifier.DeviceModel.load(str(tmp_path / "device"))
    assert again.labels == model.labels and sorted(classifier.predicted(vectors, sizes, again, mean, std).collect()) == sorted(classifier.predicted(vectors, sizes, model, mean, std).collect())
    got = dict(classifier.predicted(vectors, sizes, model, mean, std).collect())
    assert got.pop("AHU0") == "UNKNOWN" and got.pop("AHU1") == "UNINTELLIGIBLE" and all(k[:3] == v for k, v in got.items())
    run = Run(names(spark, F1), classify=True, device_classifier=lambda sizes, vectors, floor: sizes.select("concept_id", F.lit("AHU").alias("class_label")))
    assert {(r.original_point, r.representation) for r in run.resolved().collect()} >= {("AHU01/MAT", "MixedAirTemp(AHU)")}
    run.save(str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "resolved")).count() == 6


def test_empty_corpus(spark):
    run = Run(names(spark, []))
    assert run.resolved().count() == 0 and {r.value for r in run.report().collect()} == {0}


def test_settings(tmp_path, monkeypatch):
    from namelattice.config import read_settings

    monkeypatch.chdir(tmp_path)
    with pytest.raises(FileNotFoundError, match="settings.json"):
        read_settings("settings.json")
    (tmp_path / "config").mkdir()
    (tmp_path / "config" / "settings.json").write_text('{"OUTPUTFOLDER": "out/x", "SIMILARITY": 0.8, "least_members": 3, "OTHER": [1]}')
    found = read_settings("settings.json")
    assert found.OTHER == [1] and (tmp_path / "out" / "x").is_dir()
    assert Config.of(found) == Config(similarity=0.8, least_members=3)
    for bad in ("[1]", "{"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError, match="bad.json"):
            read_settings(str(tmp_path / "bad.json"))


def test_database_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    statement = connection.createStatement()
    texts = ", ".join(f'"{c}" VARCHAR(100)' for c in sinks.DATASET_COLUMNS)
    statement.execute(f'CREATE TABLE about ("dataset_id" INT GENERATED ALWAYS AS IDENTITY (START WITH 7), {texts})')
    columns = ", ".join(f'"{c}" ' + ("INT" if c == "device_id" else "VARCHAR(100)") for c in sinks.POINT_COLUMNS)
    statement.execute(f'CREATE TABLE points ({columns}, "dataset_id" INT)')
    connection.close()
    rows = [(f"AHU0{i % 3}/MAT", "x", "ai", i % 3, "y", "o", "z", "1") for i in range(9)]
    points = spark.createDataFrame(rows, "point_name string, description string, object_type string, device_id int, device_name string, object_id string, program_name string, value string")
    about = {"dataset_name": "d", "vendor": "v", "date": "2020", "distributor": "w", "site": "s"}
    properties = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    first = sinks.write_dataset(points, about, url, "about", "points", properties)
    second = sinks.write_dataset(points.limit(1), about | {"site": "t"}, url, "about", "points", properties)
    assert (first, second) == (7, 8)
    found = sources.read_points_jdbc(spark, url, "points", "7", properties)
    assert sorted(r.point_name for r in found.collect()) == ["AHU00/MAT", "AHU01/MAT", "AHU02/MAT"]
    apart = sources.read_points_jdbc(spark, url, "points", "8", properties, ("device_id", 0, 3, 2))
    assert apart.count() == 1 and Run(found.select("point_name")).names.count() == 3
    run = Run.from_database(spark, url, "points", "7", properties, ("device_id", 0, 3, 2))
    assert run.names.count() == 3 and run.report().count() > 0
    # The database filters: its scan takes the dataset's id.
    plan = sources.read_points_jdbc(spark, url, "points", "7", properties)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(dataset_id,7)" in plan.replace(" ", "")


def derby(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/once;create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    connection.createStatement().execute('CREATE TABLE target ("name" VARCHAR(100), "n" INT)')
    connection.close()
    return url, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_rows_are_written_once_or_not_at_all(spark, tmp_path):
    url, properties = derby(spark, tmp_path)
    rows = spark.range(40).select(F.concat(F.lit("n"), (F.col("id") % 13).cast("string")).alias("name"), F.when(F.col("id") > 3, F.col("id")).cast("int").alias("n"))
    assert sinks.append_once(rows, url, "target", properties) == 40
    read = lambda table="target": sorted((r.name, r.n or 0) for r in spark.read.jdbc(url, table, properties=properties).collect())
    expected = sorted((f"n{i % 13}", i if i > 3 else 0) for i in range(40))
    assert read() == expected
    # What a task leaves that committed, was lost and ran again: rows in places that are there already.
    with sinks._statements(spark, url, properties) as run:
        run('CREATE TABLE "again" AS SELECT "name", "n" FROM target WITH NO DATA')
        run('ALTER TABLE "again" ADD COLUMN "place" BIGINT')
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    sinks.stage_rows(placed, url, "again", properties)
    sinks.stage_rows(placed.where("n > 20"), url, "again", properties)
    sinks.publish_rows(spark, 40, ["name", "n"], url, "again", "target", properties)
    assert read() == sorted(expected * 2)
    # Rows missing, or other rows in one place: an error, and the table stays as it was.
    for change in ('DELETE FROM "again" WHERE "n" = 7', 'INSERT INTO "again" SELECT "name", 7, "place" FROM "again" WHERE "n" = 8'):
        with sinks._statements(spark, url, properties) as run:
            run(change)
        with pytest.raises(RuntimeError, match="again holds"):
            sinks.publish_rows(spark, 40, ["name", "n"], url, "again", "target", properties)
    assert read() == sorted(expected * 2)
    # A column that the table lacks: no rows, and no staging table either.
    with pytest.raises(Exception):
        sinks.append_once(rows.withColumn("other", F.lit(1)), url, "target", properties)
    assert read() == sorted(expected * 2)
    with sinks._statements(spark, url, properties) as run:
        assert run("SELECT count(*) FROM SYS.SYSTABLES WHERE TABLENAME LIKE 'staging%'") == 0


FAILS_ONCE = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
from namelattice.sources import sinks
from tests.test_naming import derby
url, properties = derby(spark, sys.argv[1])
kept = sinks.stage_rows
def failing(rows, *rest):
    def once(batches):
        yield from batches
        if TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("lost at the end of its rows")
    kept(rows.mapInArrow(once, rows.schema), *rest)
sinks.stage_rows = failing
rows = spark.range(0, 3000, 1, 5).selectExpr("concat('n', id) AS name", "cast(id AS int) AS n")
sinks.append_once(rows, url, "target", properties)
found = [r.n for r in spark.read.jdbc(url, "target", properties=properties).collect()]
print("FOUND", len(found), len(set(found)))
"""


def test_a_task_that_fails_once_leaves_no_repeated_and_no_missing_rows(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", FAILS_ONCE, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND 3000 3000" in done.stdout, done.stderr[-2000:]


def test_graph_by_class(spark):
    ids = spark.createDataFrame([("a", 'n"a'), ("b", "nb"), ("c", "nc")], "concept_id string, name string")
    counts = spark.createDataFrame([("a", 1), ("b", 5)], "concept_id string, n_instances long")
    edges = spark.createDataFrame([("a", "b", "derivation")], "src string, dst string, edge_type string")
    classes = spark.createDataFrame([("a", "AHU", 9), ("b", "VAV", 4), ("c", "VAV", 3)], "concept_id string, class_label string, n_points int")
    lines = [r.value for r in sinks.dot_lines(ids, counts, edges, classes).orderBy("ord").collect()]
    text_ = "\n".join(lines)
    assert text_.count("subgraph") == 3 and text_.count("{") == text_.count("}") == 4
    assert text_.index('"c" [') < text_.index("device AHU") < text_.index('"a" [label="n\'a"') < text_.index("device VAV") < text_.index('"b" [') < text_.index('"a" -> "b" [color=blue]')
    assert f"width={1.6 + 1.6094:.3f}" in text_


def test_intermediates_are_released(spark, tmp_path):
    from namelattice import storage

    with storage.released(spark):
        inner = storage.stored(spark.range(3).toDF("x"), "inner")
        kept = storage.stored(inner, "kept", keep=True)
        assert inner.count() == 3
        gone = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(gone)
    assert not os.path.exists(gone) and kept.count() == 3


def test_blocks_of_two_threads_are_apart(spark):
    from threading import Thread

    from namelattice.storage import released, stored

    kept = []
    with released(spark):
        other = Thread(target=lambda: kept.append(stored(spark.range(3), "other")))
        other.start()
        other.join()
        own = stored(spark.range(4), "own")
        assert own.count() == 4
    assert kept[0].count() == 3
    with pytest.raises(Exception):
        own.collect()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from namelattice import storage

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x", getConf=lambda: conf))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(cluster)


def test_naming_stays_without_the_training_part(monkeypatch, capsys):
    import __spark_entry__ as entry

    def fails(name):
        raise ImportError("no module of that name")

    monkeypatch.setattr(entry.importlib, "import_module", fails)
    assert "similar_pairs" in entry.queries() and not any(k.startswith("op") for k in entry.queries())
    assert "similar_pairs" in entry.oracle_sql()


def test_streamed_names(spark, tmp_path):
    from namelattice.streaming.names import tokenized_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("AHU01/SAT\nbad,line\n")
    stream = tokenized_stream(spark.readStream.text(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("names").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    assert [tuple(r.tokens) for r in spark.table("names").collect()] == [("AHU01", "SAT")]


def test_names_are_stripped_alike_in_batch_and_stream(spark, tmp_path):
    from namelattice.streaming.names import tokenized_stream

    lines = ["\tAHU1/SAT", "\u3000AHU2/SAT\xa0", " \x1fAHU3/S AT\u2028 ", "\u200bAHU4", "\x85 ", "plain"]
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    expected = {x.strip() for x in lines} - {""}
    assert {r.point_name for r in sources.name_lines(rows)[0].collect()} == expected
    assert {r.point_name for r in tokenized_stream(rows).collect()} == expected


def test_a_stream_resolves_as_a_batch_does(spark, tmp_path):
    from namelattice.streaming.names import Known, resolve_names, resolve_stream

    kinds = {"AHU": ["MAT", "RAT", "OAT", "HUM"], "VAV": ["ZN T", "ZN SP", "OCC", "RH"]}
    known_names = [f"B1/{kind}{i:02d}/{p}" for kind, points in kinds.items() for i in range(4) for p in points]
    run = Run(names(spark, known_names), Config(class_floor=0.5), classify=True)
    Known.of(run).save(str(tmp_path / "known"))
    known = Known.load(spark, str(tmp_path / "known"))
    batch = {r.original_point: tuple(r) for r in run.resolved().collect()}
    again = {r.original_point: (r.original_point, r.equipment, r.node, r.distance, r.representation) for r in resolve_names(run.points, known).collect()}
    assert batch and again == batch
    # New points of known units, a new unit, repeated names, in files that come one after the other.
    files = [known_names[:9] + ["B1/AHU00/FAN7"], [*known_names[5:20], "", "a,b", " B1/AHU00/FAN7 "], ["B1/VAV09/OCC", "other", *known_names[20:]]]
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(files):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(rows))
        # Each start is a restart from the checkpoint of the last.
        query = resolve_stream(spark.readStream.text(str(tmp_path / "in")), known, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert query.awaitTermination(120) and query.exception() is None
    kept = ["original_point", "leaf", "equipment", "node", "distance", "representation"]
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(kept).collect()))
    every = spark.createDataFrame([(x,) for rows in files for x in rows], "value string")
    assert got == sorted(map(str, resolve_names(sources.name_lines(every)[0], known).select(kept).collect()))
    assert len(got) == len({x.strip() for rows in files for x in rows} - {"", "a,b"})


def test_entry_points_agree(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["node_a", "node_b", "overlap", "size_a", "size_b"]


def test_common_prefix_over_all_names(spark):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.001"
    rows = entry.queries()["strip_common_prefix"](spark, sf_dir).collect()
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    assert len(rows) == part.select("p_brand", text.tokens(F.concat_ws("/", "p_type", "p_name"))).distinct().count()
    assert len({r.concept_id.split("/")[1] for r in rows}) > 1
    alone = {}
    for r in rows:
        alone[r.concept_id] = alone.get(r.concept_id, 0) + 1
    # The first token is shared by each concept of several names, and gone.
    assert all(alone[r.concept_id] == 1 or len(r.tokens) < len(r.rel_path) for r in rows)


def test_broadcasts_go_by_rows_not_by_files(spark):
    from namelattice.storage import stored

    Run(names(spark, F1))
    # Five columns of one long text each: a few KB as a file, 60 MB as rows.
    wide = spark.range(40_000).select("id", *(F.repeat(F.lit(c), 300).alias(c) for c in "abcde"))
    joined = stored(wide, "wide").join(stored(wide.withColumnsRenamed({c: c + "2" for c in "abcde"}), "other"), "id")
    assert joined.agg(F.count("a"), F.count("a2"), F.max("e2")).collect()[0][0] == 40_000
    done = joined.select("id", "a", "e2")
    assert len(done.toArrow()) == 40_000 and "Broadcast" not in done._jdf.queryExecution().executedPlan().toString()
    # What is small as rows too is broadcast when that is known.
    few = stored(wide, "wide").join(stored(spark.range(5).select(F.col("id"), F.lit(1).alias("one")), "few"), "id")
    assert len(few.toArrow()) == 5 and "Broadcast" in few._jdf.queryExecution().executedPlan().toString()
