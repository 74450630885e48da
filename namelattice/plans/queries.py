"""A query for each operator over names derived from the driver's tables, and their DuckDB oracles.

Lists are returned joined by ``|``, so that both engines print them alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import Config
from ..functions import text
from ..operators import catalog, classifier, clusters, labelling, scoring, semantics, similarity, tree, vocabulary
from ..sources import points as sources
from ..sources import sinks
from ..sources.catalogue import checked_model
from ..storage import fresh_path, stored
from ..streaming.names import Known, resolve_names
from . import corpora
from .pipeline import Run, training_lines

PARTS, PAGES, SUPPLY, PLANT = "parts", "pages", "supply", "plant"
#: Thresholds at which the plant's concepts differ in kind, are refined, cut and related.
PLANT_CONFIG = Config(similarity=0.75, refinement=0.9, cleanup=0.8, class_floor=0.0)


def _run(spark: SparkSession, sf_dir: str, corpus: str = PARTS, **options) -> Run:
    return Run(corpora.points(spark, sf_dir, corpus), **options)


def _plant(spark: SparkSession, sf_dir: str, **options) -> Run:
    return _run(spark, sf_dir, PLANT, config=PLANT_CONFIG, **options)


def _joined(*names: str) -> list:
    return [F.array_join(n, "|").alias(n) for n in names]


def load_names(spark, sf_dir):
    return corpora.points(spark, sf_dir, PAGES)


def rejected_names(spark, sf_dir):
    lines = corpora.lines(spark, sf_dir, PARTS).select(F.replace("value", F.lit("/"), F.when(F.contains("value", F.lit("red")), F.lit(",")).otherwise(F.lit("/"))).alias("value"))
    return sources.name_lines(lines)[1]


def distinct_points(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("event_type").alias("point_name"), F.col("props").alias("object_type"), (F.col("user_id") % 7).cast("int").alias("device_id"), F.lit(None).cast("string").alias("object_id"))
    return sources.distinct_points(rows).select(*sources.POINT_KEY)


def tokenize_points(spark, sf_dir):
    return vocabulary.tokenized(corpora.points(spark, sf_dir, PARTS)).select("point_name", *_joined("tokens"))


def uncamel(spark, sf_dir):
    return corpora.points(spark, sf_dir, PAGES).select("point_name", text.uncamel(F.col("point_name")).alias("words"))


def unique_tokens(spark, sf_dir):
    return vocabulary.unique_tokens(vocabulary.tokenized(corpora.points(spark, sf_dir, PAGES))).select("point_name", *_joined("tokens"))


def token_frequency(spark, sf_dir):
    return vocabulary.token_frequency(vocabulary.tokenized(corpora.points(spark, sf_dir, PAGES)))


def split_trailing(spark, sf_dir):
    return token_frequency(spark, sf_dir).select("token", F.array_join(text.split_trailing(F.col("token")), "|").alias("parts"))


def split_runs(spark, sf_dir):
    return token_frequency(spark, sf_dir).select("token", F.array_join(text.split_runs(F.col("token")), "|").alias("parts"))


def without_digits(spark, sf_dir):
    return vocabulary.tokenized(corpora.points(spark, sf_dir, PAGES)).select("point_name", F.array_join(text.without_digits(F.col("tokens")), "|").alias("tokens"))


def vocab_children(spark, sf_dir):
    return _run(spark, sf_dir).decomposition.select("token", *_joined("children"))


def expand_tokens(spark, sf_dir):
    return _run(spark, sf_dir).decomposition.select("token", *_joined("leaves"))


def frequency_after(spark, sf_dir, corpus=PARTS):
    return vocabulary.frequency_after(_run(spark, sf_dir, corpus).vocabulary)


def expand_tokens_pages(spark, sf_dir):
    return _run(spark, sf_dir, PAGES).decomposition.select("token", *_joined("children", "leaves"))


def point_paths(spark, sf_dir):
    return _run(spark, sf_dir).paths.select("point_name", *_joined("path"))


def tree_nodes(spark, sf_dir):
    return _run(spark, sf_dir).tree.withColumn("depth", F.col("depth").cast("long"))


def node_types(spark, sf_dir):
    return tree.node_types(_run(spark, sf_dir).paths)


def tree_leaves(spark, sf_dir):
    return tree.leaves(_run(spark, sf_dir).paths)


def point_leaf(spark, sf_dir):
    return tree.point_leaf(_run(spark, sf_dir).paths)


def leaf_parents(spark, sf_dir):
    return tree.leaf_parents(_run(spark, sf_dir).tree)


def tree_report(spark, sf_dir):
    return tree.report(_run(spark, sf_dir).tree)


def node_members(spark, sf_dir):
    return _run(spark, sf_dir).members.select("node_id", *_joined("members"), F.col("size").cast("long").alias("size"))


def parents_by_type(spark, sf_dir):
    return tree.same_type_parents(_run(spark, sf_dir).tree)


def common_edges(spark, sf_dir):
    rows = _run(spark, sf_dir).members
    return tree.common_edges(rows.where("node_id = 'BRAND1'"), rows.where("node_id = 'BRAND2'"))


def node_closure(spark, sf_dir):
    return tree.closure(_run(spark, sf_dir).tree).select("node_id", "ancestor", F.col("distance").cast("long").alias("distance"), *_joined("rel_path"))


def similar_pairs(spark, sf_dir, corpus=PARTS, ratio=0.9):
    run = _run(spark, sf_dir, corpus)
    return similarity.similar_nodes(run.tree, run.members, ratio)


def similar_pairs_asym(spark, sf_dir):
    return similarity.similar_asymmetric(_run(spark, sf_dir).members, 0.6)


def _sets(spark, sf_dir) -> DataFrame:
    run = _run(spark, sf_dir)
    return similarity.member_sets(run.tree, run.members).select(F.col("set_id").alias("concept_id"), "members")


def member_subset_pairs(spark, sf_dir):
    pairs = semantics.meeting(stored(_sets(spark, sf_dir), "sets"))
    a, b = F.col("members_a"), F.col("members_b")
    return pairs.select("a", "b", semantics.is_derived(a, b).alias("a_derives_from_b"), semantics.generalizes(a, b, 0.5).alias("a_generalizes_b"))


def common_members(spark, sf_dir):
    pairs = semantics.meeting(stored(_sets(spark, sf_dir), "sets"))
    shared = semantics.common_members(F.col("members_a"), F.col("members_b"), 0.5)
    return pairs.select("a", "b", F.array_join(F.array_sort(shared), "|").alias("members"))


def set_relations(spark, sf_dir):
    found = semantics.set_relations(stored(_sets(spark, sf_dir), "sets"))
    return found.withColumn("members", F.array_join(F.array_sort("members"), "|"))


def similar_sets(spark, sf_dir):
    """Alike sets of children; with ``node_sets`` all that ``similar_pairs_loose`` says, in rows that grow with the names alone."""
    run = _run(spark, sf_dir)
    found = similarity.similar_sets(stored(similarity.member_sets(run.tree, run.members), "sets"), 0.5)
    return found.select("a", "b", *(F.col(c).cast("long").alias(c) for c in ("overlap", "size_a", "size_b")))


def node_sets(spark, sf_dir):
    return similarity.node_sets(_run(spark, sf_dir).members)


def catalog_flat(spark, sf_dir):
    return catalog.catalog(spark).select("equip", F.col("equip_ord").cast("long").alias("equip_ord"), "label", F.col("label_ord").cast("long").alias("label_ord"), F.col("alt_ord").cast("long").alias("alt_ord"), *_joined("alt_tokens"))


def supported_labels(spark, sf_dir):
    rows = [("class", i, x) for i, x in enumerate(catalog.class_labels())] + [("point", i, x) for i, x in enumerate(catalog.point_labels())]
    return spark.createDataFrame(rows, "kind string, ord long, label string")


def token_catalog_jw(spark, sf_dir):
    found = scoring.token_catalog_similarity(token_frequency(spark, sf_dir))
    return found.select("token", "alt_token", F.round("similarity", 9).alias("similarity"))


def alike_tokens(spark, sf_dir):
    """Tokens of pages with all tokens of pages that are alike."""
    tokens = stored(token_frequency(spark, sf_dir), "tokens")
    # Rounded as it is scored: a double takes the JVM longer to round than to read.
    return scoring.alike_tokens(tokens, tokens, digits=9)


def given_catalogue_scores(spark, sf_dir):
    """Misspelt names of parts against a catalogue made of parts: types are equipment, brands labels, names alternatives."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    words = F.split(F.upper("p_name"), " ")
    model = checked_model(part.select(F.col("p_type").alias("equip"), F.col("p_brand").alias("label"), words.alias("alternative")).distinct())
    at = (F.col("p_partkey") % 7).cast("int")
    misspelt = F.split(F.concat(F.substr(F.upper("p_name"), F.lit(1), at), F.substr(F.upper("p_name"), at + 2)), " ")
    scores = scoring.label_scores(part.select(misspelt.alias("tokens")), model)
    return scores.select(*_joined("tokens"), "equip", "label", F.round("score", 9).alias("score"))


def _by_brand(spark, sf_dir) -> DataFrame:
    """The names of each brand as the points of a concept."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = text.tokens(F.concat_ws("/", "p_type", "p_name"))
    return part.select(F.col("p_brand").alias("concept_id"), path.alias("rel_path")).distinct()


def strip_common_prefix(spark, sf_dir):
    """All of part; names of a brand that begin alike are a concept, so that there is a prefix to take off."""
    named = _by_brand(spark, sf_dir).withColumn("concept_id", F.concat_ws("/", "concept_id", F.get("rel_path", F.lit(0))))
    return scoring.without_common_prefix(named).select("concept_id", *_joined("rel_path", "tokens"))


def point_label_scores(spark, sf_dir):
    scores = scoring.label_scores(_by_brand(spark, sf_dir).select(F.col("rel_path").alias("tokens")))
    return scores.select(*_joined("tokens"), "equip", "label", F.round("score", 9).alias("score"))


def feature_vector(spark, sf_dir):
    points = stored(scoring.without_common_prefix(_by_brand(spark, sf_dir)), "prepared")
    return scoring.feature_vectors(points, scoring.label_scores(points)).select("concept_id", "equip", F.col("equip_ord").cast("long").alias("equip_ord"), F.round("feature", 6).alias("feature"))


def best_points(spark, sf_dir):
    points = stored(scoring.without_common_prefix(_by_brand(spark, sf_dir)), "prepared")
    return scoring.best_points(points, scoring.label_scores(points)).select("concept_id", "equip", *_joined("rel_path"))


def ranked_labels(spark, sf_dir):
    return labelling.ranked_labels(scoring.label_scores(_by_brand(spark, sf_dir).select(F.col("rel_path").alias("tokens")))).select(*_joined("tokens"), "place", "label", F.round("score", 9).alias("score"))


def concept_clusters(spark, sf_dir):
    run = _plant(spark, sf_dir)
    return run.found.concepts.select("concept_id", *_joined("members"))


def first_concepts(spark, sf_dir):
    """Concepts as they are before refinement, by their nodes."""
    run = _plant(spark, sf_dir)
    return clusters.find_concepts(run.tree, run.members, PLANT_CONFIG.similarity).membership


def concept_members(spark, sf_dir):
    return _plant(spark, sf_dir).found.membership


def concept_names(spark, sf_dir):
    return _plant(spark, sf_dir).concept_names


def cut_edges(spark, sf_dir):
    return _plant(spark, sf_dir).cleaned[0]


def members_after(spark, sf_dir):
    return _plant(spark, sf_dir).cleaned[1].select("concept_id", *_joined("members"))


def association_edges(spark, sf_dir):
    return _plant(spark, sf_dir).edges


def derivation_edges(spark, sf_dir):
    run = _plant(spark, sf_dir)
    return semantics.derivations(run.found.concepts, run.edges)[0]


def derived_graph(spark, sf_dir):
    """Association and derivation edges together, shared associations left to bases."""
    run = _plant(spark, sf_dir)
    return semantics.with_derivations(run.edges, semantics.derivations(run.found.concepts, run.edges)[0])


def base_with_member(spark, sf_dir):
    run = _plant(spark, sf_dir)
    starts = run.found.concepts.select("concept_id", F.explode("members").alias("token"))
    derived = semantics.derivations(run.found.concepts, run.edges)[0]
    edges = derived.join(run.found.concepts.select(F.col("concept_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return semantics.base_with_member(run.found.concepts, edges, starts)


def base_usage(spark, sf_dir):
    run = _plant(spark, sf_dir)
    edges = stored(semantics.derivations(run.found.concepts, run.edges)[0], "derivation")
    return semantics.base_usage(run.found.concepts, edges, run.found.membership)


def simple_derived(spark, sf_dir):
    """Nodes of parts with one child, those of one child token being a concept: its derived classes."""
    run = _run(spark, sf_dir)
    alone = run.members.where("size = 1").select(F.element_at("members", 1).alias("concept_id"), "node_id")
    classes, edges, _ = semantics.simple_bases(run.tree, run.members, alone)
    pairs = edges.join(classes.select(F.col("concept_id").alias("dst"), "members"), "dst")
    return pairs.select(F.element_at("members", 2).alias("base"), F.element_at("members", 1).alias("token"))


def base_class_members(spark, sf_dir):
    """The nodes of ``simple_derived`` under their derived classes, all others where they were."""
    run = _run(spark, sf_dir)
    alone = stored(run.members.where("size = 1").select(F.element_at("members", 1).alias("concept_id"), "node_id"), "alone")
    classes, _, moves = semantics.simple_bases(run.tree, run.members, alone)
    ord_ = F.min(F.struct("first_point", "depth")).alias("ord")
    concepts = alone.join(run.tree, "node_id").groupBy("concept_id").agg(ord_).select("concept_id", F.array("concept_id").alias("members"), "ord")
    return clusters.with_base_classes(clusters.Concepts(concepts, alone), classes, moves).membership


def sibling_concepts(spark, sf_dir):
    run = _plant(spark, sf_dir)
    return semantics.siblings(semantics.derivations(run.found.concepts, run.edges)[0])


def concept_points(spark, sf_dir):
    return _plant(spark, sf_dir).unlabelled.select("concept_id", *_joined("rel_path"), "label", "score", "point_name")


def leaf_coverage(spark, sf_dir):
    run = _plant(spark, sf_dir)
    return semantics.explained_leaves(run.leaves, run.closure, run.found.membership)


def unexplained_points(spark, sf_dir):
    return semantics.unexplained_points(leaf_coverage(spark, sf_dir))


def unique_points(spark, sf_dir):
    run = _plant(spark, sf_dir)
    return semantics.unique_points(run.tree, run.closure, run.found.membership)


def concept_classes(spark, sf_dir):
    return _plant(spark, sf_dir, classify=True).classes


def revised_classes(spark, sf_dir):
    """Parts as assemblies: part i uses 2i and 2i + 1; some use parts above them, in cycles of two, three and one."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    key = F.col("p_partkey")
    above = {"2": F.lit(True), "4": key % 89 == 0}
    down = [part.where(on).select(F.floor(key / int(by)).alias("src"), key.alias("dst")) for by, on in above.items() if by == "2"]
    up = [part.where(key % 97 == 0).select(key.alias("src"), F.floor(key / 2).alias("dst")), part.where(above["4"]).select(key.alias("src"), F.floor(key / 4).alias("dst")), part.where(key % 101 == 0).select(key.alias("src"), key.alias("dst"))]
    links = down[0]
    for more in up:
        links = links.unionByName(more)
    edges = links.select(*(F.col(c).cast("long").cast("string").alias(c) for c in ("src", "dst")), F.lit("association").alias("edge_type"))
    named = F.array(*map(F.lit, ("AHU", "AHU", "VAV", "VRF", "UNKNOWN", "UNKNOWN", "UNKNOWN")))
    own = part.where("p_size % 8 < 7").select(key.cast("string").alias("concept_id"), F.get(named, (F.col("p_size") % 8).cast("int")).alias("class_label"))
    return labelling.concept_classes(part.select(key.cast("string").alias("concept_id")), edges, own)


def fitted_classes(spark, sf_dir):
    """Each supplier as a unit of one equipment, its points alternatives of the catalogue; a model fitted on three quarters of them, saved and loaded, tells all.

    Every sixth unit lacks the last label, every fiftieth has one point only.
    """
    key = F.col("s_suppkey")
    units = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (key % 3).cast("int").alias("equip_ord"))
    named = catalog.catalog(spark).groupBy("equip", "equip_ord", "label_ord").agg(F.array_sort(F.collect_list(F.struct("alt_ord", "alt_tokens"))).alias("alts"))
    last = F.max("label_ord").over(Window.partitionBy("equip_ord"))
    points = units.join(F.broadcast(named.withColumn("last", last)), "equip_ord").where((key % 6 != 5) | (F.col("label_ord") < F.col("last"))).where((key % 50 != 7) | (F.col("label_ord") == 0))
    chosen = F.get("alts", ((key + F.col("label_ord")) % F.size("alts")).cast("int"))["alt_tokens"]
    points = stored(points.select(key.cast("string").alias("concept_id"), F.array(F.col("label_ord").cast("string")).alias("rel_path"), chosen.alias("tokens"), "equip"), "points")
    plain = points.drop("equip")
    vectors = stored(scoring.feature_vectors(plain, scoring.label_scores(plain)), "features")
    held_out = F.col("concept_id").cast("long") % 4 == 2
    learned = points.where(~held_out).select("concept_id", F.col("equip").alias("class_label")).distinct()
    mean, std = classifier.fitted_scaler(vectors.where(~held_out))
    path = fresh_path(spark, "device")
    classifier.train(vectors.where(~held_out), learned, mean, std, iterations=10).save(path)
    sizes = points.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))
    found = classifier.predicted(vectors, sizes, classifier.DeviceModel.load(path), mean, std)
    return found.withColumn("held_out", held_out)


def greedy_assign_few(spark, sf_dir):
    """Parts of a brand and a size as the points of a concept, often fewer than there are labels; the size says which class."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = text.tokens(F.concat_ws("/", "p_type", "p_name"))
    rows = part.select(F.concat_ws("/", "p_brand", "p_size").alias("concept_id"), path.alias("rel_path")).distinct()
    points = stored(scoring.without_common_prefix(rows), "prepared")
    last = F.substring_index("concept_id", "/", -1).cast("int") % 3
    classes = points.select("concept_id", F.get(F.array(*map(F.lit, catalog.class_codes())), last).alias("class_label")).distinct()
    return labelling.assigned_labels(points, classes, Config(catalog_merge="flat")).select("concept_id", *_joined("rel_path"), "label", F.round("score", 9).alias("score"))


def greedy_assign(spark, sf_dir):
    points = stored(scoring.without_common_prefix(_by_brand(spark, sf_dir)), "prepared")
    classes = points.select("concept_id", F.lit("VAV").alias("class_label")).distinct()
    return labelling.assigned_labels(points, classes).select("concept_id", *_joined("rel_path"), "label", F.round("score", 9).alias("score"))


def label_candidates(spark, sf_dir):
    found = _plant(spark, sf_dir).candidates()
    return found.select("point_name", F.explode("cands").alias("c")).select("point_name", "c.*")


def candidate_text(spark, sf_dir):
    return sinks.candidate_lines(_plant(spark, sf_dir).candidates())


def candidates_file(spark, sf_dir):
    """The CSV of candidates, read back."""
    path = fresh_path(spark, "candidates")
    sinks.write_candidates(_plant(spark, sf_dir).candidates(), path, "csv")
    lists = {"className": "array<string>", "clusterID": "array<string>", "label": "array<string>", "distance": "array<double>"}
    rows = spark.read.option("header", True).csv(path)
    return rows.select("pointName", *(F.array_join(F.from_json(name, kind).cast("array<string>"), "|").alias(name) for name, kind in lists.items()))


def resolved_file(spark, sf_dir):
    """The CSV of resolved names, read back."""
    path = fresh_path(spark, "resolved")
    sinks.write_resolved(_plant(spark, sf_dir).resolved(), path)
    return spark.read.option("header", True).csv(path).withColumn("Distance", F.col("Distance").cast("double"))


def resolve_best(spark, sf_dir):
    return _plant(spark, sf_dir).resolved()


def resolve_classified(spark, sf_dir):
    return _plant(spark, sf_dir, classify=True).resolved().withColumn("distance", F.round("distance", 9))


def resolve_new_names(spark, sf_dir):
    """Names of the plant against what a classified run over them knows, one at a time as a stream takes them."""
    run = _plant(spark, sf_dir, classify=True)
    found = resolve_names(run.points, Known.of(run)).where("node IS NOT NULL")
    return found.select("original_point", "equipment", "node", F.round("distance", 9).alias("distance"), "representation")


def class_summary(spark, sf_dir):
    run = _plant(spark, sf_dir, classify=True)
    return semantics.class_summary(run.classes, run.found.membership)


def class_instances(spark, sf_dir):
    return semantics.class_instances(_plant(spark, sf_dir).found.membership)


def run_report(spark, sf_dir):
    return _plant(spark, sf_dir).report()


def dot_graph(spark, sf_dir):
    run = _plant(spark, sf_dir)
    return sinks.dot_lines(run.concept_names, semantics.class_instances(run.found.membership), run.edges)


def cluster_file(spark, sf_dir):
    run = _plant(spark, sf_dir)
    return sinks.cluster_json(run.concept_points, run.classes, run.found.membership)


def training_file(spark, sf_dir):
    points = _by_brand(spark, sf_dir).select(F.col("concept_id").alias("cluster"), F.lit("VAV").alias("class_label"), F.lit(0).alias("at"), F.col("rel_path").alias("tokens"), F.lit("").alias("point_label"))
    return training_lines(points)


def resolved_argmax(spark, sf_dir):
    """The best candidate of each name where candidates come from a table: orders' priorities as classes."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    nearest = orders.groupBy(F.col("o_custkey").cast("string").alias("point_name"), F.col("o_orderpriority").alias("class")).agg(F.min("o_orderkey").alias("ord"), F.max(F.floor(F.col("o_totalprice") / 50000)).cast("double").alias("score"))
    one = F.struct("ord", "class", F.lit("n").alias("node"), F.lit("l").alias("label"), "score")
    return labelling.resolved(nearest.groupBy("point_name").agg(F.collect_list(one).alias("cands")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "similar_pairs": similar_pairs,
        "similar_pairs_supply": partial(similar_pairs, corpus=SUPPLY),
        "similar_pairs_loose": partial(similar_pairs, ratio=0.5),
        "frequency_after_pages": partial(frequency_after, corpus=PAGES),
        **{
            f.__name__: f
            for f in (
                load_names, rejected_names, distinct_points, tokenize_points, uncamel, unique_tokens, token_frequency, split_trailing, split_runs, without_digits,
                vocab_children, expand_tokens, expand_tokens_pages, frequency_after, point_paths, tree_nodes, node_types, tree_leaves, point_leaf, leaf_parents, tree_report,
                node_members, parents_by_type, common_edges, node_closure, similar_pairs_asym, member_subset_pairs, common_members, set_relations, similar_sets, node_sets, catalog_flat,
                supported_labels, token_catalog_jw, alike_tokens, given_catalogue_scores, strip_common_prefix, point_label_scores, feature_vector, best_points, ranked_labels, concept_clusters, first_concepts,
                concept_members, concept_names, cut_edges, members_after, association_edges, derivation_edges, derived_graph, base_with_member, base_usage, simple_derived, base_class_members, sibling_concepts, concept_points,
                leaf_coverage, unexplained_points, unique_points, concept_classes, revised_classes, fitted_classes, greedy_assign, greedy_assign_few, label_candidates, candidate_text, candidates_file, resolved_file, resolve_best, resolve_classified, resolve_new_names,
                class_summary, class_instances, run_report, dot_graph, cluster_file, training_file, resolved_argmax,
            )
        },
    }


# --- oracles -------------------------------------------------------------------------------------------------------

_LINES = {
    PARTS: "SELECT DISTINCT concat_ws('/', p_brand, p_type, p_name) AS v FROM part",
    PAGES: "SELECT url AS v FROM pages",
    SUPPLY: """SELECT DISTINCT concat_ws('/', r_name, n_name, s_name, p_type) AS v FROM lineitem JOIN part ON l_partkey = p_partkey
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    PLANT: f"""SELECT DISTINCT concat_ws('/', replace(n_name, ' ', ''), {corpora.PLANT_UNIT.format(text="VARCHAR")}, {corpora.PLANT_MEMBER}, child) AS v
      FROM supplier JOIN (VALUES {", ".join(str(row).replace("None", "NULL") for row in corpora.PLANT_ROWS)}) k(kind, unit, place, member, child) ON s_suppkey % {len(corpora.KINDS)} = kind
      JOIN nation ON s_nationkey = n_nationkey WHERE {corpora.PLANT_HAS}""",
}


def _points_sql(corpus: str) -> str:
    return f"pts AS (SELECT DISTINCT trim(v) AS point_name FROM ({_LINES[corpus]}) WHERE trim(v) <> '' AND NOT contains(v, ','))"


def _is(kind: str, c: str) -> str:
    return f"({c} <> {'upper' if kind == 'lower' else 'lower'}({c}) AND {c} = {kind}({c}))"


def _uncamel_sql(s: str) -> str:
    at = lambda k: f"{s}[i {k}]" if k else f"{s}[i]"
    lower = f"i >= 2 AND i <= length({s}) - 2 AND {_is('lower', at(''))} AND {_is('upper', at('+ 1'))}"
    pair = f"i >= 3 AND i <= length({s}) - 1 AND {_is('upper', at('- 1'))} AND {_is('upper', at(''))} AND {_is('lower', at('+ 1'))}"
    parted = f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: upper({at('')}) || CASE WHEN ({lower}) OR ({pair}) THEN ' ' ELSE '' END), '')"
    return f"CASE WHEN length({s}) < 3 THEN upper({s}) WHEN length({s}) = 3 THEN upper({s}[1]) ELSE {parted} END"


def _tokens_sql(s: str) -> str:
    return f"list_filter(list_transform(string_split_regex(translate({_uncamel_sql(s)}, '-_.:#', '    '), '[/ ]'), lambda t: trim(t)), lambda t: t <> '')"


def _head(t: str) -> str:
    return f"regexp_extract({t}, '^(.*?)([0-9]+)$', 1)"


def _tail(t: str) -> str:
    return f"regexp_extract({t}, '^(.*?)([0-9]+)$', 2)"


def _trailing(t: str) -> str:
    return f"CASE WHEN {_tail(t)} = '' OR {_head(t)} = '' THEN [{t}] ELSE [{_head(t)}, {_tail(t)}] END"


def _runs(t: str) -> str:
    return f"regexp_extract_all({t}, '[\\p{{L}}]+|\\d+')"


def _names_sql(corpus: str) -> str:
    return f"WITH {_points_sql(corpus)}, tk AS (SELECT point_name, {_tokens_sql('point_name')} AS tokens FROM pts)"


def _vocabulary_sql(corpus: str) -> str:
    """Children by digits and runs; on this corpus no token follows another inside a third."""
    return f"""{_names_sql(corpus)},
occ AS (SELECT point_name, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS token FROM tk),
v0 AS (SELECT DISTINCT token FROM occ),
v1 AS (SELECT DISTINCT unnest([token] || {_trailing('token')}) AS token FROM v0),
voc AS (SELECT DISTINCT unnest([token] || {_runs('token')}) AS token FROM v1),
al AS (SELECT token, list_filter({_trailing('token')} || {_runs('token')}, lambda x: x <> token) AS l FROM voc),
ch AS (SELECT token, list_filter(l, lambda x, i: list_position(l, x) = i) AS children FROM al),
k AS (SELECT token, generate_subscripts(children, 1) AS pos, unnest(children) AS child FROM ch),
g AS (SELECT k.token, flatten(list(CASE WHEN len(c.children) = 0 THEN [c.token] ELSE c.children END ORDER BY pos)) AS leaves FROM k JOIN ch c ON c.token = k.child GROUP BY 1),
lv AS (SELECT ch.token, children, coalesce(leaves, [ch.token]) AS leaves FROM ch LEFT JOIN g USING (token))"""


def _followed_sql(words: str, name: str, levels: int = 10) -> str:
    """``name(token, parts)``: what the first token of ``words`` inside each that isn't used up itself leaves of it, chains of at most ``levels``."""
    part = lambda i, group: f"regexp_extract(s[{i}], '^([0-9]+)([A-Z]+)?', {group})"
    parts = [f""",
{name}c AS MATERIALIZED (SELECT * FROM (SELECT token, piece, list_filter([{part(1, 1)}, {part(1, 2)}, {part(2, 1)}, {part(2, 2)}], lambda x: x <> '') AS parts
  FROM (SELECT o.token, i.token AS piece, string_split(o.token, i.token) AS s FROM {words} o JOIN {words} i ON length(i.token) >= 3 AND o.token <> i.token AND contains(o.token, i.token) WHERE regexp_matches(o.token, '[0-9]'))
  WHERE len(s) = 2) WHERE len(parts) > 0),
{name}d(token, d) AS (SELECT token, 0 FROM {words} UNION SELECT c.token, x.d + 1 FROM {name}d x JOIN {name}c c ON c.piece = x.token),
{name}l AS MATERIALIZED (SELECT token, max(d) AS d FROM {name}d GROUP BY 1),
{name}0 AS MATERIALIZED (SELECT token, FALSE AS used FROM {name}l WHERE d = 0)"""]
    for k in range(1, levels + 1):
        parts.append(f""",
{name}{k} AS MATERIALIZED (SELECT * FROM {name}{k - 1} UNION ALL SELECT c.token, bool_or(NOT p.used) FROM {name}c c JOIN {name}l USING (token) JOIN {name}{k - 1} p ON p.token = c.piece WHERE d = {k} GROUP BY 1)""")
    parts.append(f""",
{name} AS MATERIALIZED (SELECT c.token, arg_min(parts, (length(piece), piece)) AS parts FROM {name}c c JOIN {name}{levels} p ON p.token = c.piece WHERE NOT p.used GROUP BY 1)""")
    return "".join(parts)


def _fallen_sql(corpus: str) -> str:
    """Children ``ch``, leaves ``lv`` and frequencies ``fa`` with what tokens inside others leave."""
    return f"""{_names_sql(corpus).replace('WITH ', 'WITH RECURSIVE ', 1)},
occ AS (SELECT point_name, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS token FROM tk),
fr AS (SELECT token, count(*) AS frequency FROM occ GROUP BY 1),
v1 AS (SELECT DISTINCT unnest([token] || {_trailing('token')}) AS token FROM fr),
w1 AS MATERIALIZED (SELECT DISTINCT unnest([token] || {_runs('token')}) AS token FROM v1){_followed_sql('w1', 'fa1_')},
w2 AS MATERIALIZED (SELECT token FROM w1 UNION SELECT unnest(parts) FROM fa1_){_followed_sql('w2', 'fa2_')},
w3 AS MATERIALIZED (SELECT token FROM w2 UNION SELECT unnest(parts) FROM fa2_),
al AS (SELECT token, list_filter({_trailing('token')} || {_runs('token')} || coalesce(a.parts, []) || coalesce(b.parts, []), lambda x: x <> token) AS l FROM w3 LEFT JOIN fa1_ a USING (token) LEFT JOIN fa2_ b USING (token)),
ch AS MATERIALIZED (SELECT token, list_filter(l, lambda x, i: list_position(l, x) = i) AS children FROM al),
k AS (SELECT token, generate_subscripts(children, 1) AS pos, unnest(children) AS child FROM ch),
walk(token, place, part) AS (SELECT token, []::BIGINT[], token FROM ch UNION ALL SELECT w.token, list_append(w.place, k.pos), k.child FROM walk w JOIN k ON k.token = w.part),
lv AS (SELECT token, list(part ORDER BY place) AS leaves FROM walk WHERE part NOT IN (SELECT token FROM k) GROUP BY 1),
ye AS MATERIALIZED (SELECT token, unnest({_trailing('token')}) AS part FROM fr UNION ALL SELECT token, unnest({_runs('token')}) FROM v1 UNION ALL SELECT token, unnest(parts) FROM fa1_
  UNION ALL SELECT token, unnest(parts) FROM fa2_ UNION ALL SELECT token, unnest({_trailing('token')}) FROM w3),
ba AS (SELECT token, frequency, coalesce(frequency, 0) + coalesce(times, 0) - 1 AS less_one FROM w3 LEFT JOIN fr USING (token) LEFT JOIN (SELECT part AS token, count(*) AS times FROM ye GROUP BY 1) USING (token)),
hd(token, less_one) AS (SELECT token, less_one FROM ba UNION ALL SELECT k.child, hd.less_one FROM hd JOIN k USING (token)),
fa AS (SELECT token, length(token) AS size, frequency, CAST(after AS BIGINT) + 1 AS frequency_after FROM ba JOIN (SELECT token, sum(less_one) AS after FROM hd GROUP BY 1) USING (token))"""


def _tree_sql(corpus: str) -> str:
    return f"""{_vocabulary_sql(corpus)},
paths AS (SELECT point_name, flatten(list(leaves ORDER BY pos)) AS path FROM occ JOIN lv USING (token) GROUP BY 1),
walk AS (SELECT point_name, path, unnest(range(1, len(path) + 1)) AS depth FROM paths),
o AS (SELECT point_name, depth, array_to_string(path[:depth], '') AS node_id, path[depth] AS token,
  CASE WHEN depth > 1 THEN array_to_string(path[:depth - 1], '') END AS parent_id, depth = len(path) AS ends FROM walk),
nodes AS (SELECT node_id, arg_min(token, point_name) AS token, min_by({{'p': parent_id}}, point_name).p AS parent_id, arg_min(depth, point_name) AS depth,
  min(point_name) AS first_point, bool_or(ends) AS is_point, arg_min(ends, point_name) AS is_point_first FROM o GROUP BY 1),
mem AS (SELECT parent_id AS node_id, list(token ORDER BY first_point, depth, token) AS members, count(*) AS size FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1)"""


def _similar_sql(corpus: str, ratio: str) -> str:
    return f"""{_tree_sql(corpus)},
e AS (SELECT node_id, size, unnest(members) AS token FROM mem WHERE size >= 2),
pair AS (SELECT a.node_id AS node_a, b.node_id AS node_b, count(*) AS overlap, a.size AS size_a, b.size AS size_b
  FROM e a JOIN e b ON a.token = b.token AND a.node_id < b.node_id GROUP BY ALL)
SELECT * FROM pair WHERE (size_a = size_b OR greatest(size_a, size_b) - least(size_a, size_b) < least(size_a, size_b) * (1.0::DOUBLE - {ratio}::DOUBLE))
  AND overlap / greatest(size_a, size_b) >= {ratio}::DOUBLE"""


_BRAND_SQL = f"""WITH b AS (SELECT DISTINCT p_brand AS concept_id, {_tokens_sql('s')} AS rel_path FROM (SELECT p_brand, concat_ws('/', p_type, p_name) AS s FROM part))"""
_STRIPPED_SQL = """,
pr AS (SELECT concept_id, rel_path, list_filter(rel_path, lambda t: NOT regexp_full_match(t, '[0-9]+')) AS tokens FROM {source}),
tot AS (SELECT concept_id, count(*) AS n, min(len(tokens)) AS shortest FROM pr GROUP BY 1),
pl AS (SELECT concept_id, place, count(*) AS k, min(token) AS lo, max(token) AS hi FROM (SELECT concept_id, generate_subscripts(tokens, 1) - 1 AS place, unnest(tokens) AS token FROM pr) GROUP BY 1, 2),
br AS (SELECT concept_id, min(place) AS first FROM pl JOIN tot USING (concept_id) WHERE k <> n OR lo <> hi GROUP BY 1),
cut AS (SELECT concept_id, CASE WHEN n > 1 THEN coalesce(first, shortest) ELSE 0 END AS c FROM tot LEFT JOIN br USING (concept_id)),
st AS (SELECT concept_id, rel_path, tokens[c + 1:] AS tokens FROM pr JOIN cut USING (concept_id))"""


def _catalog_sql(model: catalog.Model | None = None) -> str:
    escaped = lambda alt: "', '".join(t.replace("'", "''") for t in alt)
    rows = [
        f"('{equip}', {i}, '{label}', {j}, {k}, ['{escaped(alt)}'])"
        for i, (equip, labels) in enumerate((model or catalog.equipment_model()).items())
        for j, (label, alts) in enumerate(labels.items())
        for k, alt in enumerate(alts)
    ]
    return f"cat AS (SELECT * FROM (VALUES {', '.join(rows)}) t(equip, equip_ord, label, label_ord, alt_ord, alt_tokens))"


def _scores_sql(source: str, model: catalog.Model | None = None, catalogue: str | None = None) -> str:
    best = "coalesce(list_max(list_filter(list_transform(alt_tokens, lambda a: jaro_winkler_similarity(t, a)), lambda x: x > 0.85::DOUBLE)), 0)"
    joined = "array_to_string(tokens, '')"
    return f""",
{catalogue or _catalog_sql(model)},
pt AS (SELECT DISTINCT tokens FROM {source}),
raw AS (SELECT tokens, equip, equip_ord, label, alt_tokens,
  coalesce(list_sum(list_transform(tokens, lambda t: {best})), 0) / greatest(len(tokens), len(alt_tokens)) AS s,
  CASE WHEN len(alt_tokens) = 1 AND len(tokens) > 0 THEN jaro_winkler_similarity({joined}, alt_tokens[1]) * (least(length({joined}), length(alt_tokens[1]))::DOUBLE / greatest(length({joined}), length(alt_tokens[1]))) ELSE 0 END AS w
  FROM pt, cat),
sc AS (SELECT tokens, equip, equip_ord, label, max(CASE WHEN len(tokens) = 0 THEN 0 WHEN tokens = alt_tokens THEN 1 WHEN w > s AND w > 0.1::DOUBLE THEN w ELSE s END)::DOUBLE AS score FROM raw GROUP BY 1, 2, 3, 4)"""


def _renamed(sql: str, **names: str) -> str:
    """``sql`` with tables named otherwise, so that two parts can stand in one statement."""
    for old, new in names.items():
        sql = re.sub(rf"\b{old}\b(?=$| AS \(|[ ,).]|\n)(?<!AS {old})", new, sql)
    return sql


def _revised_sql(levels: int) -> str:
    """Classes ``cls`` from ``own(concept_id, own)`` and ``assoc(src, dst)``, at most ``levels`` links above each other."""
    parts = [""",
lk AS MATERIALIZED (SELECT DISTINCT src, dst FROM assoc WHERE src IN (SELECT concept_id FROM own) AND dst IN (SELECT concept_id FROM own)),
rc(x, y) AS (SELECT src, dst FROM lk UNION SELECT rc.x, lk.dst FROM rc JOIN lk ON lk.src = rc.y),
cy AS MATERIALIZED (SELECT a.x, a.y FROM rc a JOIN rc b ON a.x = b.y AND a.y = b.x),
ln AS MATERIALIZED (SELECT src, dst, src = dst OR cy.x IS NOT NULL AS within FROM lk LEFT JOIN cy ON cy.x = src AND cy.y = dst),
lev(c, d) AS (SELECT concept_id, 0 FROM own UNION SELECT ln.src, lev.d + 1 FROM lev JOIN ln ON ln.dst = lev.c WHERE NOT within),
lvl AS MATERIALIZED (SELECT c, max(d) AS d FROM lev GROUP BY 1),
s0 AS MATERIALIZED (SELECT concept_id, own AS label, FALSE AS takes FROM own JOIN lvl ON c = concept_id WHERE d = 0)"""]
    for k in range(1, levels + 1):
        parts.append(f""",
s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL
  SELECT concept_id, CASE WHEN len(seen) = 1 AND seen[1] <> 'UNKNOWN' THEN 'CONTAINER' WHEN seen IN (['AHU', 'UNKNOWN'], ['UNKNOWN', 'VRF']) THEN own
    WHEN len(seen) > 1 AND len(list_intersect(seen, ['VAV', 'AHU', 'VRF'])) > 0 THEN 'COMPOSITE' ELSE own END, own = 'AHU' AND seen IN (['AHU', 'UNKNOWN'], ['UNKNOWN', 'VRF'])
  FROM (SELECT own.concept_id, own, list_sort(list_distinct(list(CASE WHEN within THEN 'UNKNOWN' ELSE p.label END))) AS seen
    FROM lvl JOIN own ON own.concept_id = c JOIN ln ON ln.src = c LEFT JOIN s{k - 1} p ON p.concept_id = ln.dst WHERE d = {k} GROUP BY 1, 2))""")
    parts.append(f""",
cls AS MATERIALIZED (SELECT concept_id, CASE WHEN concept_id IN (SELECT dst FROM ln JOIN s{levels} t ON t.concept_id = ln.src WHERE takes AND src <> dst) THEN 'UNKNOWN' ELSE label END AS class_label FROM s{levels})""")
    return "".join(parts)


def _assigned_sql() -> str:
    """Labels ``asg`` of stripped points ``sp`` by scores ``sc`` over ``cat`` and classes ``cls``: the first pair again and again."""
    return """,
pairs AS MATERIALIZED (SELECT concept_id, array_to_string(rel_path, '|') AS path, label, score, row_number() OVER (PARTITION BY concept_id ORDER BY round(score, 12) DESC, label_ord, rel_path) AS i
  FROM sp JOIN cls USING (concept_id) JOIN sc ON sc.tokens = sp.tokens AND sc.equip = class_label JOIN (SELECT DISTINCT equip, label, label_ord FROM cat) USING (equip, label)),
gr(concept_id, i, labels, paths, ok) AS (SELECT DISTINCT concept_id, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], FALSE FROM pairs UNION ALL
  SELECT concept_id, i, CASE WHEN free THEN list_append(labels, label) ELSE labels END, CASE WHEN free THEN list_append(paths, path) ELSE paths END, free
  FROM (SELECT p.concept_id, p.i, p.label, p.path, g.labels, g.paths, NOT list_contains(g.labels, p.label) AND NOT list_contains(g.paths, p.path) AS free
    FROM gr g JOIN pairs p ON p.concept_id = g.concept_id AND p.i = g.i + 1)),
asg AS MATERIALIZED (SELECT concept_id, path, label, score FROM gr JOIN pairs USING (concept_id, i) WHERE ok)"""


def _classes_sql() -> str:
    """Classes ``cls`` of the plant's concepts, from the features of their points ``sp``."""
    stripped = _renamed(_STRIPPED_SQL.format(source="cp"), st="sp", cut="cutp")
    return f"""{stripped}{_scores_sql('sp')},
lab AS (SELECT equip, equip_ord, count(DISTINCT label) AS labels FROM cat GROUP BY 1, 2),
bst AS (SELECT concept_id, equip, label, max(score) AS best FROM sp JOIN sc USING (tokens) GROUP BY 1, 2, 3),
tot2 AS (SELECT concept_id, equip, sum(round(best, 12)) AS total FROM bst GROUP BY 1, 2),
npt AS (SELECT concept_id, count(*) AS n FROM cp GROUP BY 1),
ft AS (SELECT concept_id, equip, equip_ord, round(CASE WHEN n > 1 AND n < 150 THEN pow(3 * coalesce(total, 0) / labels, 2) ELSE 0 END, 9) AS feature FROM npt CROSS JOIN lab LEFT JOIN tot2 USING (concept_id, equip)),
top AS (SELECT concept_id, arg_max(equip, (feature, -equip_ord)) AS equip, max(feature) AS f FROM ft GROUP BY 1),
own AS MATERIALIZED (SELECT concept_id, CASE WHEN n > 150 THEN 'UNINTELLIGIBLE' WHEN n >= 2 AND f >= {PLANT_CONFIG.class_floor}::DOUBLE THEN equip ELSE 'UNKNOWN' END AS own FROM con LEFT JOIN npt USING (concept_id) LEFT JOIN top USING (concept_id))
{_revised_sql(8)}"""


def _resolved_sql() -> str:
    """The best candidate of each name with classes and labels."""
    labels = _renamed(_scores_sql("sp", catalog.point_model(PLANT_CONFIG.catalog_merge)), cat="cat2", pt="pt2", raw="raw2", sc="sc2")
    return f"""{_classes_sql()}{labels}{_renamed(_assigned_sql(), cat="cat2", sc="sc2")},
cand AS (SELECT lf.point_name, class_label AS class, ms.node_id AS node, up.distance, coalesce(asg.label, 'UNKNOWN') AS label, round(coalesce(asg.score, 0), 9)::DOUBLE AS score
  FROM lf JOIN up ON up.node_id = lf.leaf_id JOIN ms ON ms.node_id = up.ancestor JOIN cls ON cls.concept_id = ms.concept_id
  LEFT JOIN asg ON asg.concept_id = ms.concept_id AND asg.path = array_to_string(up.rel_path, '|')),
close AS (SELECT point_name, class, min((distance, node, label, score)) AS c FROM cand GROUP BY 1, 2)"""


def _set_pairs_sql(select: str) -> str:
    return f"""{_tree_sql(PARTS)},
ms AS (SELECT sha256(array_to_string(list_sort(members), '␟')) AS id, arg_min(members, (first_point, depth)) AS m FROM mem JOIN (SELECT node_id, first_point, depth FROM nodes) USING (node_id) WHERE size >= 2 GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, a.m AS ma, b.m AS mb, list_intersect(a.m, b.m) AS x FROM ms a JOIN ms b ON a.id <> b.id AND len(list_intersect(a.m, b.m)) > 0)
SELECT a, b, {select} FROM p"""


def _alike_sql(a: str, b: str, ratio: float) -> str:
    return f"""({a}.size = {b}.size OR greatest({a}.size, {b}.size) - least({a}.size, {b}.size) < least({a}.size, {b}.size) * (1.0::DOUBLE - {ratio}::DOUBLE))
    AND len(list_intersect({a}.members, {b}.members)) / greatest({a}.size, {b}.size) >= {ratio}::DOUBLE"""


def _model_sql(select: str, more: str = "") -> str:
    """The whole model of the plant: seeds one set after the other, clusters that share a set merged, refined, cut, related."""
    c = PLANT_CONFIG
    return f"""{_tree_sql(PLANT).replace('WITH ', 'WITH RECURSIVE ', 1)},
st AS (SELECT m.node_id, sha256(array_to_string(list_sort(m.members), '␟')) AS set_id, m.members, m.size, n.first_point, n.depth FROM mem m JOIN nodes n USING (node_id) WHERE m.size >= 2),
sets AS (SELECT set_id, arg_min(members, (first_point, depth)) AS members, min(size) AS size, min((first_point, depth)) AS ord, count(*) AS n_nodes FROM st GROUP BY 1),
alk AS (SELECT x.set_id AS a, y.set_id AS b FROM sets x JOIN sets y ON x.set_id <> y.set_id WHERE {_alike_sql('x', 'y', c.similarity)}),
act AS (SELECT *, row_number() OVER (ORDER BY ord) AS i FROM sets WHERE n_nodes > 1 OR set_id IN (SELECT a FROM alk)),
nb AS (SELECT act.i, coalesce(list(o.i) FILTER (o.i < act.i), []) AS l FROM act LEFT JOIN alk ON alk.a = act.set_id LEFT JOIN act o ON o.set_id = alk.b GROUP BY 1),
greedy(i, s) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT nb.i, CASE WHEN len(list_intersect(nb.l, greedy.s)) = 0 THEN list_append(greedy.s, nb.i) ELSE greedy.s END FROM greedy JOIN nb ON nb.i = greedy.i + 1),
seed AS (SELECT set_id FROM act JOIN (SELECT unnest(arg_max(s, i)) AS i FROM greedy) USING (i)),
star AS (SELECT a, b FROM alk WHERE a IN (SELECT set_id FROM seed) UNION SELECT b, a FROM alk WHERE a IN (SELECT set_id FROM seed)),
reach(x, y) AS (SELECT set_id, set_id FROM act UNION SELECT reach.x, star.b FROM reach JOIN star ON star.a = reach.y),
cm AS (SELECT x AS set_id, min(y) AS comp FROM reach GROUP BY 1),
c0 AS (SELECT comp, arg_min(set_id, (size, ord)) AS concept_id, arg_min(members, (size, ord)) AS members, min(ord) AS ord FROM act JOIN cm USING (set_id) GROUP BY 1),
held AS (SELECT set_id, c0.concept_id, act.members, size, act.ord, n_nodes, row_number() OVER (ORDER BY act.ord) AS i FROM act JOIN cm USING (set_id) JOIN c0 USING (comp)),
m0 AS (SELECT concept_id, node_id FROM st JOIN held USING (set_id)),
al2 AS (SELECT x.i, y.i AS j FROM held x JOIN held y ON x.concept_id = y.concept_id AND x.i <> y.i WHERE {_alike_sql('x', 'y', c.refinement)}),
nb2 AS (SELECT held.i, coalesce(list(j) FILTER (j < held.i), []) AS l FROM held LEFT JOIN al2 USING (i) GROUP BY 1),
greedy2(i, s) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT nb2.i, CASE WHEN len(list_intersect(nb2.l, greedy2.s)) = 0 THEN list_append(greedy2.s, nb2.i) ELSE greedy2.s END FROM greedy2 JOIN nb2 ON nb2.i = greedy2.i + 1),
ld AS (SELECT nb2.i, coalesce(list_min(list_intersect(l, s)), nb2.i) AS lead FROM nb2, (SELECT arg_max(s, i) AS s FROM greedy2)),
led AS (SELECT h.set_id, h.concept_id, h.n_nodes, o.set_id AS leader FROM held h JOIN ld USING (i) JOIN held o ON o.i = ld.lead),
moved AS (SELECT concept_id, leader FROM led WHERE leader NOT IN (SELECT concept_id FROM c0) GROUP BY 1, 2 HAVING sum(n_nodes) > 1),
fin AS (SELECT led.set_id, CASE WHEN moved.leader IS NULL THEN led.concept_id ELSE moved.leader END AS concept_id FROM led LEFT JOIN moved ON moved.concept_id = led.concept_id AND moved.leader = led.leader),
con AS (SELECT concept_id, members, ord FROM c0 UNION ALL SELECT set_id, members, ord FROM sets WHERE set_id IN (SELECT leader FROM moved)),
ms AS (SELECT concept_id, st.node_id, n.token, n.parent_id, n.first_point, n.depth FROM st JOIN fin USING (set_id) JOIN nodes n USING (node_id)),
ce AS (SELECT p.concept_id, q.concept_id AS child_concept, q.token, q.node_id, q.parent_id, q.first_point, q.depth FROM ms q JOIN ms p ON p.node_id = q.parent_id WHERE p.concept_id <> q.concept_id),
tests AS (SELECT t.*, row_number() OVER (PARTITION BY t.concept_id ORDER BY f, token) AS k, con.members AS child_members
  FROM (SELECT concept_id, token, child_concept, min((first_point, depth)) AS f FROM ce GROUP BY 1, 2, 3) t JOIN con ON con.concept_id = t.child_concept),
cutting(concept_id, k, own, token, child_concept, cut) AS (SELECT concept_id, 0::BIGINT, members, ''::VARCHAR, ''::VARCHAR, FALSE FROM con UNION ALL
  SELECT r.concept_id, t.k, CASE WHEN r.ok THEN list_filter(r.own, lambda x: x <> t.token) ELSE r.own END, t.token, t.child_concept, r.ok
  FROM (SELECT g.concept_id, g.own, g.k, len(u.child_members) > 1 AND len(g.own) > 4 AND len(list_intersect(g.own, u.child_members)) >= (len(g.own) - 1) * {c.cleanup}::DOUBLE AS ok
    FROM cutting g JOIN tests u ON u.concept_id = g.concept_id AND u.k = g.k + 1) r JOIN tests t ON t.concept_id = r.concept_id AND t.k = r.k + 1),
after AS (SELECT concept_id, arg_max(own, k) AS members FROM cutting GROUP BY 1),
cut AS (SELECT DISTINCT parent_id, node_id FROM ce JOIN cutting USING (concept_id, token, child_concept) WHERE cut),
ed AS (SELECT node_id, parent_id, token FROM nodes WHERE parent_id IS NOT NULL AND node_id NOT IN (SELECT node_id FROM cut)),
up AS (SELECT node_id, parent_id AS ancestor, 1::BIGINT AS distance, [token] AS rel_path FROM ed
  UNION ALL SELECT up.node_id, ed.parent_id, up.distance + 1, [ed.token] || up.rel_path FROM up JOIN ed ON ed.node_id = up.ancestor),
fi AS (SELECT DISTINCT ON (concept_id) * FROM ms ORDER BY concept_id, first_point, depth, node_id),
lf AS (SELECT node_id AS leaf_id, min(point_name) AS point_name FROM o WHERE ends GROUP BY 1),
inner_nodes AS (SELECT DISTINCT ancestor FROM up),
assoc AS (SELECT DISTINCT a.concept_id AS src, b.concept_id AS dst
  FROM (SELECT ms.node_id, ms.concept_id, ms.token, arg_min(up.ancestor, up.distance) AS above FROM ms JOIN up USING (node_id) WHERE up.ancestor IN (SELECT node_id FROM ms) GROUP BY 1, 2, 3) b
  JOIN ms a ON a.node_id = b.above JOIN after ON after.concept_id = a.concept_id WHERE list_contains(after.members, b.token)),
cov AS (SELECT leaf_id, point_name, leaf_id IN (SELECT node_id FROM ms) OR leaf_id IN (SELECT up.node_id FROM up JOIN ms ON ms.node_id = up.ancestor) AS explained FROM lf),
cp AS (SELECT fi.concept_id, up.rel_path, min(n.first_point) AS point_name
  FROM fi JOIN after ON after.concept_id = fi.concept_id AND len(after.members) BETWEEN {c.least_members} AND {c.most_members} JOIN up ON up.ancestor = fi.node_id JOIN nodes n ON n.node_id = up.node_id
  WHERE n.is_point_first OR n.node_id NOT IN (SELECT ancestor FROM inner_nodes) GROUP BY 1, 2),
hide AS (SELECT up.node_id, min(distance) AS nearest FROM up WHERE ancestor IN (SELECT node_id FROM ms) GROUP BY 1),
uniq AS (SELECT fi.concept_id, count(hide.node_id) AS n_points FROM fi LEFT JOIN (SELECT * FROM up WHERE node_id NOT IN (SELECT ancestor FROM inner_nodes) AND node_id NOT IN (SELECT node_id FROM ms)) e ON e.ancestor = fi.node_id
  LEFT JOIN hide ON hide.node_id = e.node_id AND hide.nearest = e.distance GROUP BY 1),
near AS (SELECT point_name, arg_min(ms.node_id, distance) AS node, min(distance) AS ord FROM lf JOIN up ON up.node_id = lf.leaf_id JOIN ms ON ms.node_id = up.ancestor GROUP BY 1),
rel AS (SELECT a.concept_id AS a, b.concept_id AS b, a.members AS ma, b.members AS mb, list_intersect(a.members, b.members) AS x FROM con a JOIN con b ON a.concept_id <> b.concept_id
  WHERE len(list_intersect(a.members, b.members)) > 0 AND (a.concept_id, b.concept_id) NOT IN (SELECT (src, dst) FROM assoc) AND (b.concept_id, a.concept_id) NOT IN (SELECT (src, dst) FROM assoc)),
dir AS (SELECT *, len(ma) > 2 AND len(ma) < len(mb) AND len(x) = len(ma) AS down, len(mb) > 2 AND len(mb) < len(ma) AND len(x) = len(mb) AS above FROM rel),
shared AS (SELECT a, b, sha256(array_to_string(list_sort(x), '␟')) AS base FROM dir WHERE NOT down AND NOT above AND a < b AND len(x) >= 0.7::DOUBLE * len(ma) AND len(x) >= 0.7::DOUBLE * len(mb)),
derived AS (SELECT a AS src, b AS dst FROM dir WHERE down UNION SELECT base, a FROM shared WHERE base <> a UNION SELECT base, b FROM shared WHERE base <> b),
family(base, concept_id) AS (SELECT concept_id, concept_id FROM con WHERE concept_id NOT IN (SELECT dst FROM derived) UNION SELECT f.base, d.dst FROM family f JOIN derived d ON d.src = f.concept_id){more}
{select}"""


def _quoted(values: list[str], kind: str) -> str:
    return ", ".join(f"('{kind}', {i}, '{v}')" for i, v in enumerate(values))


def oracle_sql() -> dict[str, str]:
    joined = lambda *names: ", ".join(f"array_to_string({n}, '|') AS {n}" for n in names)
    parts, pages, tree_of_parts = _names_sql(PARTS), _names_sql(PAGES), _tree_sql(PARTS)
    tokens_of_pages = f"{pages}, f AS (SELECT token, length(token) AS size, count(*) AS frequency FROM (SELECT unnest(tokens) AS token FROM tk) GROUP BY 1)"
    ordered = "list_filter(tokens, lambda x, i: list_position(tokens, x) = i)"
    named = "CASE p_size % 8 WHEN 0 THEN 'AHU' WHEN 1 THEN 'AHU' WHEN 2 THEN 'VAV' WHEN 3 THEN 'VRF' ELSE 'UNKNOWN' END"
    few = f"""WITH RECURSIVE b AS (SELECT DISTINCT concat_ws('/', p_brand, p_size) AS concept_id, {_tokens_sql('s')} AS rel_path FROM (SELECT p_brand, p_size, concat_ws('/', p_type, p_name) AS s FROM part)),
      cls AS (SELECT DISTINCT concept_id, ['AHU', 'VAV', 'VRF'][CAST(string_split(concept_id, '/')[-1] AS INT) % 3 + 1] AS class_label FROM b)"""
    many = f"{_BRAND_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, cls AS (SELECT DISTINCT concept_id, 'VAV' AS class_label FROM b)"
    stripped = _renamed(_STRIPPED_SQL.format(source="b"), st="sp", cut="cutp")
    return {
        "revised_classes": f"""WITH RECURSIVE own AS MATERIALIZED (SELECT CAST(p_partkey AS VARCHAR) AS concept_id, {named} AS own FROM part),
          assoc AS (SELECT CAST(a AS VARCHAR) AS src, CAST(b AS VARCHAR) AS dst FROM (SELECT p_partkey // 2 AS a, p_partkey AS b FROM part UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey % 97 = 0
            UNION SELECT p_partkey, p_partkey // 4 FROM part WHERE p_partkey % 89 = 0 UNION SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 101 = 0)){_revised_sql(18)} SELECT concept_id, class_label FROM cls""",
        # What the units are; the fitted model has to tell it, of those held out too.
        "fitted_classes": """SELECT CAST(s_suppkey AS VARCHAR) AS concept_id, CASE WHEN s_suppkey % 50 = 7 THEN 'UNKNOWN' ELSE ['AHU', 'VAV', 'VRF'][s_suppkey % 3 + 1] END AS class_label,
          s_suppkey % 4 = 2 AS held_out FROM supplier""",
        "greedy_assign": f"{many}{stripped}{_scores_sql('sp', catalog.point_model())}{_assigned_sql()} SELECT concept_id, path AS rel_path, label, round(score, 9) AS score FROM asg",
        "greedy_assign_few": f"{few}{stripped}{_scores_sql('sp', catalog.point_model('flat'))}{_assigned_sql()} SELECT concept_id, path AS rel_path, label, round(score, 9) AS score FROM asg",
        "concept_classes": _model_sql("SELECT concept_id, class_label FROM cls", _classes_sql()),
        "resolve_classified": _model_sql("""SELECT point_name AS original_point, class AS equipment, c[2] AS node, c[4] AS distance, c[3] AS representation
          FROM (SELECT *, row_number() OVER (PARTITION BY point_name ORDER BY c[4] DESC, c[1], class DESC) AS place FROM close) WHERE place = 1""", _resolved_sql()),
        "resolve_new_names": _model_sql("""SELECT point_name AS original_point, class AS equipment, c[2] AS node, c[4] AS distance, c[3] AS representation
          FROM (SELECT *, row_number() OVER (PARTITION BY point_name ORDER BY c[4] DESC, c[1], class DESC) AS place FROM close) WHERE place = 1""", _resolved_sql()),
        "class_summary": _model_sql("SELECT class_label, count(DISTINCT concept_id) AS n_concepts, count(node_id) AS n_instances FROM cls LEFT JOIN ms USING (concept_id) GROUP BY 1", _classes_sql()),
        "similar_pairs": _similar_sql(PARTS, "0.9"),
        "similar_pairs_supply": _similar_sql(SUPPLY, "0.9"),
        "similar_pairs_loose": _similar_sql(PARTS, "0.5"),
        "load_names": f"WITH {_points_sql(PAGES)} SELECT * FROM pts",
        "rejected_names": f"SELECT v AS value FROM (SELECT CASE WHEN contains(v, 'red') THEN replace(v, '/', ',') ELSE v END AS v FROM ({_LINES[PARTS]})) WHERE contains(v, ',')",
        "distinct_points": "SELECT DISTINCT event_type AS point_name, props AS object_type, CAST(user_id % 7 AS INT) AS device_id, ' ' AS object_id FROM events",
        "tokenize_points": f"{parts} SELECT point_name, {joined('tokens')} FROM tk",
        "uncamel": f"WITH {_points_sql(PAGES)} SELECT point_name, {_uncamel_sql('point_name')} AS words FROM pts",
        "unique_tokens": f"{pages} SELECT point_name, array_to_string({ordered}, '|') AS tokens FROM tk",
        "token_frequency": f"{tokens_of_pages} SELECT * FROM f",
        "split_trailing": f"{tokens_of_pages} SELECT token, array_to_string({_trailing('token')}, '|') AS parts FROM f",
        "split_runs": f"{tokens_of_pages} SELECT token, array_to_string({_runs('token')}, '|') AS parts FROM f",
        "without_digits": f"{pages} SELECT point_name, array_to_string(list_filter(tokens, lambda t: NOT regexp_full_match(t, '[0-9]+')), '|') AS tokens FROM tk",
        "vocab_children": f"{_vocabulary_sql(PARTS)} SELECT token, {joined('children')} FROM lv",
        "expand_tokens_pages": f"{_fallen_sql(PAGES)} SELECT token, {joined('children', 'leaves')} FROM ch JOIN lv USING (token)",
        "frequency_after": f"{_fallen_sql(PARTS)} SELECT * FROM fa",
        "frequency_after_pages": f"{_fallen_sql(PAGES)} SELECT * FROM fa",
        "expand_tokens": f"{_vocabulary_sql(PARTS)} SELECT token, {joined('leaves')} FROM lv",
        "point_paths": f"{tree_of_parts} SELECT point_name, {joined('path')} FROM paths",
        "tree_nodes": f"{tree_of_parts} SELECT * FROM nodes",
        "node_types": f"{tree_of_parts} SELECT DISTINCT token, node_id FROM o",
        "tree_leaves": f"{tree_of_parts} SELECT node_id AS leaf_id, min(point_name) AS point_name, count(*) AS n_points FROM o WHERE ends GROUP BY 1",
        "point_leaf": f"{tree_of_parts} SELECT point_name, node_id AS leaf_id FROM o WHERE ends",
        "leaf_parents": f"{tree_of_parts} SELECT DISTINCT parent_id AS node_id FROM nodes WHERE is_point AND parent_id IS NOT NULL",
        "tree_report": f"""{tree_of_parts} SELECT 'nodes' AS metric, count(*) AS value FROM nodes UNION ALL SELECT 'leaves', count(*) FROM nodes WHERE is_point
          UNION ALL SELECT 'types', count(DISTINCT token) FROM nodes""",
        "node_members": f"{tree_of_parts} SELECT node_id, {joined('members')}, size FROM mem",
        "parents_by_type": f"{tree_of_parts} SELECT DISTINCT token, parent_id FROM nodes WHERE parent_id IS NOT NULL",
        "common_edges": f"{tree_of_parts} SELECT count(*) AS n FROM (SELECT unnest(members) AS t FROM mem WHERE node_id = 'BRAND1') JOIN (SELECT unnest(members) AS t FROM mem WHERE node_id = 'BRAND2') USING (t)",
        "node_closure": f"""{tree_of_parts.replace('WITH ', 'WITH RECURSIVE ', 1)},
          up AS (SELECT node_id, parent_id AS ancestor, 1::BIGINT AS distance, [token] AS rel_path FROM nodes WHERE parent_id IS NOT NULL
            UNION ALL SELECT up.node_id, n.parent_id, up.distance + 1, [n.token] || up.rel_path FROM up JOIN nodes n ON n.node_id = up.ancestor WHERE n.parent_id IS NOT NULL)
          SELECT node_id, ancestor, distance, {joined('rel_path')} FROM up""",
        "leaf_coverage": _model_sql("SELECT leaf_id, point_name, explained FROM cov"),
        "unexplained_points": _model_sql("SELECT point_name FROM cov WHERE NOT explained"),
        "concept_clusters": _model_sql("SELECT concept_id, array_to_string(members, '|') AS members FROM con"),
        "first_concepts": _model_sql("SELECT concept_id, node_id FROM m0"),
        "concept_members": _model_sql("SELECT concept_id, node_id FROM ms"),
        "members_after": _model_sql("SELECT concept_id, array_to_string(members, '|') AS members FROM after"),
        "cut_edges": _model_sql("SELECT parent_id, node_id FROM cut"),
        "class_instances": _model_sql("SELECT concept_id, count(*) AS n_instances FROM ms GROUP BY 1"),
        "concept_names": _model_sql("""SELECT con.concept_id, coalesce(array_to_string(list_transform([coalesce(a.token, ''), mem.members[1], fi.token], lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN '' ELSE t END), '_'), con.concept_id) AS name
          FROM con LEFT JOIN fi USING (concept_id) LEFT JOIN mem USING (node_id) LEFT JOIN nodes a ON a.node_id = fi.parent_id"""),
        "concept_points": _model_sql("SELECT concept_id, array_to_string(rel_path, '|') AS rel_path, 'UNKNOWN' AS label, 0.0::DOUBLE AS score, point_name FROM cp"),
        "unique_points": _model_sql("SELECT concept_id, n_points FROM uniq"),
        "label_candidates": _model_sql("SELECT point_name, ord::INT AS ord, 'UNKNOWN' AS class, node, 'UNKNOWN' AS label, 0.0::DOUBLE AS score FROM near"),
        "resolve_best": _model_sql("SELECT point_name AS original_point, 'UNKNOWN' AS equipment, node, 0.0::DOUBLE AS distance, 'UNKNOWN' AS representation FROM near"),
        "association_edges": _model_sql("SELECT src, dst, 'association' AS edge_type FROM assoc"),
        "derivation_edges": _model_sql("SELECT src, dst, 'derivation' AS edge_type FROM derived"),
        "derived_graph": _model_sql("""SELECT src, dst, 'association' AS edge_type FROM assoc WHERE NOT EXISTS (SELECT 1 FROM derived d WHERE d.dst = assoc.src
            AND ((d.src, assoc.dst) IN (SELECT (src, dst) FROM assoc) OR (d.src, assoc.dst) IN (SELECT (src, dst) FROM derived))) UNION SELECT src, dst, 'derivation' FROM derived"""),
        "base_with_member": _model_sql("""SELECT s.concept_id, s.token, arg_max(w.here, w.n) AS base_id FROM (SELECT concept_id, unnest(members) AS token FROM con) s
          JOIN walks w ON w.concept_id = s.concept_id AND w.token = s.token GROUP BY 1, 2""", """,
nxt AS (SELECT dst AS concept_id, min(src) AS next FROM derived WHERE src IN (SELECT concept_id FROM con) GROUP BY 1),
walks(concept_id, token, here, seen, n) AS (SELECT concept_id, unnest(members), concept_id, [concept_id], 0 FROM con UNION ALL
  SELECT w.concept_id, w.token, nxt.next, list_append(w.seen, nxt.next), w.n + 1 FROM walks w JOIN nxt ON nxt.concept_id = w.here JOIN con ON con.concept_id = nxt.next
  WHERE list_contains(con.members, w.token) AND NOT list_contains(w.seen, nxt.next))"""),
        "simple_derived": f"""{tree_of_parts}, one AS (SELECT m.members[1] AS base, n.token FROM mem m JOIN nodes n USING (node_id) WHERE m.size = 1)
          SELECT DISTINCT base, token FROM one WHERE NOT regexp_full_match(token, '[0-9]+') AND base IN
            (SELECT base FROM one WHERE NOT regexp_full_match(base, '[0-9]+') GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT token) FILTER (NOT regexp_full_match(token, '[0-9]+')) > 1)""",
        "base_class_members": f"""{tree_of_parts}, one AS (SELECT m.members[1] AS base, n.token, node_id FROM mem m JOIN nodes n USING (node_id) WHERE m.size = 1),
          fits AS (SELECT base FROM one WHERE NOT regexp_full_match(base, '[0-9]+') GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT token) FILTER (NOT regexp_full_match(token, '[0-9]+')) > 1)
          SELECT node_id, CASE WHEN fits.base IS NOT NULL AND NOT regexp_full_match(token, '[0-9]+') THEN sha256(array_to_string(list_sort([token, one.base]), '␟')) ELSE one.base END AS concept_id
          FROM one LEFT JOIN fits ON one.base = fits.base""",
        "sibling_concepts": _model_sql("SELECT DISTINCT l.dst AS a, r.dst AS b FROM derived l JOIN derived r ON l.src = r.src AND l.dst <> r.dst"),
        "candidate_text": _model_sql("SELECT concat_ws(',' || chr(9), point_name, 'UNKNOWN', node, 'UNKNOWN', '0.0') AS value FROM near"),
        "candidates_file": _model_sql("""SELECT point_name AS "pointName", 'UNKNOWN' AS "className", node AS "clusterID", 'UNKNOWN' AS label, '0.0' AS distance FROM near"""),
        "resolved_file": _model_sql("""SELECT point_name AS "OriginalPoint", 'UNKNOWN' AS "Equipment", node AS "Node", 0.0::DOUBLE AS "Distance", 'UNKNOWN' AS "Representation" FROM near"""),
        "base_usage": _model_sql("SELECT base AS concept_id, count(DISTINCT concept_id) - 1 AS n_classes, count(DISTINCT node_id) AS n_instances FROM family LEFT JOIN ms USING (concept_id) GROUP BY 1"),
        "run_report": _model_sql("""SELECT 'nodes' AS metric, count(*) AS value FROM nodes UNION ALL SELECT 'leaves', count(*) FROM nodes WHERE is_point UNION ALL SELECT 'types', count(DISTINCT token) FROM nodes
          UNION ALL SELECT 'explained', count(*) FROM cov WHERE explained UNION ALL SELECT 'unexplained', count(*) FROM cov WHERE NOT explained
          UNION ALL SELECT 'unique_points', CAST(sum(n_points) AS BIGINT) FROM uniq UNION ALL SELECT 'concepts', count(*) FROM con"""),
        "similar_pairs_asym": f"""{tree_of_parts}, e AS (SELECT node_id, size, unnest(members) AS token FROM mem WHERE size >= 2),
          pair AS (SELECT a.node_id AS node_a, b.node_id AS node_b, count(*) AS overlap, a.size AS sa, b.size AS sb FROM e a JOIN e b ON a.token = b.token AND a.node_id <> b.node_id GROUP BY ALL)
          SELECT node_a, node_b, overlap FROM pair WHERE (sa = sb OR greatest(sa, sb) - least(sa, sb) < least(sa, sb) * (1.0::DOUBLE - 0.6::DOUBLE)) AND overlap / sa >= 0.6::DOUBLE""",
        "member_subset_pairs": _set_pairs_sql("""len(mb) > 2 AND len(ma) > len(mb) AND len(x) = len(mb) AS a_derives_from_b,
          len(ma) > 2 AND len(ma) < len(mb) AND len(x) = len(ma) AND len(ma) >= 0.5::DOUBLE * len(mb) AS a_generalizes_b"""),
        "common_members": _set_pairs_sql("CASE WHEN len(x) >= 0.5::DOUBLE * len(ma) AND len(x) >= 0.5::DOUBLE * len(mb) THEN array_to_string(list_sort(x), '|') ELSE '' END AS members"),
        "set_relations": f"""SELECT * FROM ({_set_pairs_sql("""len(mb) > 2 AND len(ma) > len(mb) AND len(x) = len(mb) AS a_derives_from_b,
          len(ma) > 2 AND len(ma) < len(mb) AND len(x) = len(ma) AND len(ma) >= 0.5::DOUBLE * len(mb) AS a_generalizes_b,
          CASE WHEN len(x) >= 0.5::DOUBLE * len(ma) AND len(x) >= 0.5::DOUBLE * len(mb) THEN array_to_string(list_sort(x), '|') ELSE '' END AS members""")}) WHERE a_derives_from_b OR a_generalizes_b OR members <> ''""",
        "similar_sets": f"""SELECT a, b, overlap, size_a, size_b FROM ({_set_pairs_sql("len(x)::BIGINT AS overlap, len(ma)::BIGINT AS size_a, len(mb)::BIGINT AS size_b")})
          WHERE a < b AND (size_a = size_b OR greatest(size_a, size_b) - least(size_a, size_b) < least(size_a, size_b) * (1.0::DOUBLE - 0.5::DOUBLE)) AND overlap / greatest(size_a, size_b) >= 0.5::DOUBLE""",
        "node_sets": f"{tree_of_parts} SELECT node_id, sha256(array_to_string(list_sort(members), '␟')) AS set_id FROM mem WHERE size >= 2",
        "catalog_flat": f"WITH {_catalog_sql()} SELECT equip, equip_ord::BIGINT AS equip_ord, label, label_ord::BIGINT AS label_ord, alt_ord::BIGINT AS alt_ord, {joined('alt_tokens')} FROM cat",
        "supported_labels": f"SELECT kind, ord::BIGINT AS ord, label FROM (VALUES {_quoted(catalog.class_labels(), 'class')}, {_quoted(catalog.point_labels(), 'point')}) t(kind, ord, label)",
        "token_catalog_jw": f"""{tokens_of_pages}, {_catalog_sql()}, a AS (SELECT DISTINCT unnest(alt_tokens) AS alt_token FROM cat)
          SELECT token, alt_token, round(jaro_winkler_similarity(token, alt_token), 9) AS similarity FROM f, a WHERE jaro_winkler_similarity(token, alt_token) > 0.85::DOUBLE""",
        "alike_tokens": f"""{tokens_of_pages} SELECT a.token, b.token AS alt_token, round(jaro_winkler_similarity(a.token, b.token), 9) AS similarity FROM f a, f b
          WHERE jaro_winkler_similarity(a.token, b.token) > 0.85::DOUBLE""",
        "given_catalogue_scores": "WITH q AS (SELECT string_split(substr(upper(p_name), 1, p_partkey % 7) || substr(upper(p_name), p_partkey % 7 + 2), ' ') AS tokens FROM part)" + _scores_sql(
            "q", catalogue="cat AS MATERIALIZED (SELECT DISTINCT p_type AS equip, 0 AS equip_ord, p_brand AS label, string_split(upper(p_name), ' ') AS alt_tokens FROM part)"
        ) + f" SELECT {joined('tokens')}, equip, label, round(score, 9) AS score FROM sc",
        "strip_common_prefix": f"{_BRAND_SQL}, s AS (SELECT concat_ws('/', concept_id, rel_path[1]) AS concept_id, rel_path FROM b){_STRIPPED_SQL.format(source='s')} SELECT concept_id, {joined('rel_path', 'tokens')} FROM st",
        "point_label_scores": f"{_BRAND_SQL}, q AS (SELECT rel_path AS tokens FROM b){_scores_sql('q')} SELECT {joined('tokens')}, equip, label, round(score, 9) AS score FROM sc",
        "feature_vector": f"""{_BRAND_SQL}{_STRIPPED_SQL.format(source='b')}{_scores_sql('st')},
          lab AS (SELECT equip, equip_ord, count(DISTINCT label) AS labels FROM cat GROUP BY 1, 2),
          best AS (SELECT concept_id, equip, label, max(score) AS best FROM st JOIN sc USING (tokens) GROUP BY 1, 2, 3),
          total AS (SELECT concept_id, equip, sum(best) AS total FROM best GROUP BY 1, 2),
          n AS (SELECT concept_id, count(*) AS n FROM st GROUP BY 1)
          SELECT concept_id, equip, equip_ord::BIGINT AS equip_ord, round(CASE WHEN n > 1 AND n < 150 THEN pow(3 * coalesce(total, 0) / labels, 2) ELSE 0 END, 6)::DOUBLE AS feature
          FROM n CROSS JOIN lab LEFT JOIN total USING (concept_id, equip)""",
        "best_points": f"""{_BRAND_SQL}{_STRIPPED_SQL.format(source='b')}{_scores_sql('st')},
          last AS (SELECT equip, arg_max(label, label_ord) AS label FROM cat GROUP BY 1)
          SELECT concept_id, equip, {joined('rel_path')} FROM (SELECT concept_id, equip, rel_path, row_number() OVER (PARTITION BY concept_id, equip ORDER BY round(score, 12) DESC, rel_path) AS place
            FROM st JOIN sc USING (tokens) JOIN last USING (equip, label)) WHERE place = 1""",
        "ranked_labels": f"""{_BRAND_SQL}, q AS (SELECT rel_path AS tokens FROM b){_scores_sql('q')},
          by_place AS (SELECT tokens, sc.equip, sc.label, score, row_number() OVER (PARTITION BY tokens ORDER BY round(score, 12) DESC, sc.equip_ord, label_ord) AS place
            FROM sc JOIN (SELECT DISTINCT equip, label, label_ord FROM cat) USING (equip, label))
          SELECT {joined('tokens')}, place::INT AS place, label, round(score, 9) AS score FROM by_place WHERE place <= 3""",
        "resolved_argmax": """WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS point_name, o_orderpriority AS class, min(o_orderkey) AS ord, max(floor(o_totalprice / 50000))::DOUBLE AS score FROM orders GROUP BY 1, 2)
          SELECT point_name AS original_point, arg_max(class, (score, -ord)) AS equipment, 'n' AS node, max(score) AS distance, 'l' AS representation FROM c GROUP BY 1""",
    }
