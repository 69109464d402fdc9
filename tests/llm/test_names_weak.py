"""Nicknames of several names, with every order of the forms' ids."""

import random

import pytest
from pyspark.sql import functions as F

from loam.llm.names import Nearby, common_given, edit_distance, entities, linked_names, name_entities, typo_links


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_a_nickname_of_two_names_joins_the_one_in_use(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        cores = [f"{a}{b}dinhanroth" for a in ("kar", "vel", "tos", "mu") for b in ("bo", "li", "za", "re", "nu")]
        full = {c: ("alexander", "alexandra")[i % 2] for i, c in enumerate(cores)}
        nodes = [(f"{g}-{c}", "person", None) for c in cores for g in (full[c], "alex")]
        nodes += [(f"{g}-bothrirvil", "person", None) for g in ("alexander", "alexandra", "alex", "al")]
        aliases = spark.createDataFrame([(i, f"Alex {c.title()}", None) for i, c in enumerate(cores)], "alias_no long, alias string, canonical string")
        got = {tuple(r) for r in linked_names(spark.createDataFrame(nodes, "id string, node_type string, label string"), aliases).collect()}
        want = {("node_pair", f"alex-{c}", f"{full[c]}-{c}") for c in cores}
        want |= {("alias_node", str(i), f"{g}-{c}") for i, c in enumerate(cores) for g in (full[c], "alex")}
        assert got == want | {("node_pair", "al-bothrirvil", "alexander-bothrirvil")}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("flip", [False, True])
def test_both_orders_of_the_forms(spark, flip):
    weak = ["alexander", "alexandra"][:: -1 if flip else 1]
    rows = [("n", "alex", "P", "dinhanroth", w, True) for w in weak] + [("n", "full", "P", "dinhanroth", "alexander", False)]
    read = spark.createDataFrame(rows, "src string, key string, cls string, core string, other string, weak boolean")
    assert entities(read.coalesce(1).orderBy(F.lit(1))).select("entity").distinct().count() == 1


def one_edit_each(word):
    letters = "abz"
    yield from (word[:i] + word[i + 1 :] for i in range(len(word)))
    yield from (word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters)
    yield from (word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters)
    yield from (word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1))


@pytest.mark.parametrize("edits, words", [(1, ["berg", "dinhan", "vurfilo", "karbonroth"]), (2, ["vurfilo", "karbonroth"])])
def test_every_pair_within_the_edits_is_linked(spark, edits, words):
    cores = set(words) | {y for w in words for y in one_edit_each(w)}
    if edits == 2:
        rng = random.Random(5)
        some = sorted(rng.sample(sorted(cores), 60))
        cores = set(some) | {rng.choice(list(one_edit_each(x))) for x in some}
    cores = sorted(c for c in cores if len(c) >= 4)
    rows = [(i, "P", c, "ann") for i, c in enumerate(cores)]
    forms = spark.createDataFrame(rows, "form long, cls string, core string, other string")
    got = {frozenset((cores[r["u"]], cores[r["v"]])) for r in typo_links(forms, edits).collect()}
    assert got == {frozenset((a, b)) for i, a in enumerate(cores) for b in cores[i + 1 :] if edit_distance(a, b, edits) <= edits}


def test_near_words():
    near = Nearby({"stefan", "stefano", "imre", "ann"})
    assert near.find("stefam") == "stefan" and near.find("setfan") == "stefan" and near.find("irme") == "imre"
    assert near.find("stefann") == "stefan" or near.find("stefann") is None
    assert near.find("an") is None and near.find("zzzz") is None and near.find("anna") is None


def test_given_names_do_not_depend_on_the_size(spark):
    def names(copies):
        rows = [(f"{g} sur{c}x{i}y{k}",) for c in range(copies) for g, n in (("imre", 9), ("stefan", 12)) for i in range(n) for k in range(2)]
        return spark.createDataFrame(rows + [("rare person",)] * 3, "text string").withColumn("kind", F.lit("person"))

    assert common_given(names(1)) == common_given(names(40))
    assert {"imre", "stefan"} <= common_given(names(1)) and "rare" not in common_given(names(1))


def test_members_and_pairs_agree(spark, small):
    nodes, aliases = spark.read.parquet(f"{small}/nodes.parquet"), spark.read.parquet(f"{small}/aliases.parquet")
    members = name_entities(nodes, aliases).collect()
    assert len({(r["src"], r["key"]) for r in members}) == len(members)
    of = {}
    for r in members:
        of.setdefault(r["entity"], {"n": [], "a": []})[r["src"]].append(r["key"])
    want = {("node_pair", *sorted((a, b))) for x in of.values() for a in x["n"] for b in x["n"] if a != b} | {("alias_node", a, b) for x in of.values() for a in x["a"] for b in x["n"]}
    assert {tuple(r) for r in linked_names(nodes, aliases).collect()} == want and len(want) > 20
