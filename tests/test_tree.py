"""Taxonomy topology and Newick."""

from pyspark.sql import functions as F

from sporeframe.operators import tree as tr


def test_induced_subtree_contracts_single_child_nodes(spark):
    # root -> k -> {p1 -> {s1, s2}, p2 -> q -> s3}, plus unrelated s4 under p1
    edges = spark.createDataFrame(
        [("k", "root"), ("p1", "k"), ("p2", "k"), ("s1", "p1"), ("s2", "p1"), ("s4", "p1"), ("q", "p2"), ("s3", "q")],
        "child string, parent string")
    chosen = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "node string")
    got = {r["child"]: r["parent"] for r in tr.induced_subtree(edges, chosen).collect()}
    # root, k->p2 chain single child above? k has 2 kids (p1, p2) -> kept as root; p2, q have one child -> removed
    assert got == {"k": None, "p1": "k", "s1": "p1", "s2": "p1", "s3": "k"}
    names = spark.createDataFrame([(n, n.upper()) for n in ["k", "p1", "s1", "s2", "s3"]], "node string, name string")
    nwk = tr.newick(tr.name_nodes(tr.induced_subtree(edges, chosen), names)).first()[0]
    assert nwk == "((S1:1,S2:1)P1:1,S3:1)K;"


def test_a_deep_chain_and_a_wide_tree(spark):
    depth = 150
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(depth)] + [("leaf", "n149"), ("twig", "n75")]
    edges = spark.createDataFrame(chain, "child string, parent string")
    tree = tr.induced_subtree(edges, spark.createDataFrame([("leaf",), ("twig",), ("n149",)], "node string"))
    assert {(r["child"], r["parent"]) for r in tree.collect()} == {("leaf", "n149"), ("twig", "n75"), ("n149", "n75"), ("n75", None)}
    upper = spark.createDataFrame(chain[:20], "child string, parent string")
    names = upper.select(F.col("child").alias("node"), F.col("child").alias("name"))
    whole = tr.newick(tr.name_nodes(upper, names)).first()["newick"]
    assert whole.count("(") == 19 and whole.endswith("n0;")
    wide = spark.range(1_100_000).select(F.concat(F.lit("c"), "id").alias("child"), F.lit("root").alias("parent"))
    assert tr.with_ancestors(wide, wide.select(F.col("child").alias("node"))).count() == 1_100_001


def test_a_cycle_is_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(tr, "MAX_ROUNDS", 3)
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        tr.with_ancestors(loop, loop.select(F.col("child").alias("node")))


def plain_newick(edges, name):
    kids = {}
    for child, parent in edges:
        kids.setdefault(parent, []).append(child)

    def text(node, length=":1"):
        below = sorted(kids.get(node, []), key=lambda c: (name(c), c))
        return (f"({','.join(map(text, below))})" if below else "") + name(node) + length

    return "".join(text(r, ";") for r in sorted(kids[None], key=lambda c: (name(c), c)))


def test_newick_rows_of_random_forests(spark, tmp_path):
    import random

    rng = random.Random(4)
    edges = [("r0", None), ("r1", None), ("lone", None)] + [(f"n{i}", rng.choice(["r0", "r1"] + [f"n{j}" for j in range(max(0, i - 30), i)])) for i in range(400)]
    edges += [(f"w{i}", "n3") for i in range(500)] + [(f"c{i}", f"c{i - 1}" if i else "n5") for i in range(70)]
    label = lambda c: f"same{len(c)}" if c.startswith("n") else c  # noqa: E731  many equal names
    tree = spark.createDataFrame([(c, p, label(c)) for c, p in edges], "child string, parent string, name string")
    rows = tr.newick_rows(tree).collect()
    assert sorted(r["place"] for r in rows) == list(range(len(rows)))
    want = plain_newick(edges, label)
    assert "".join(r["text"] for r in sorted(rows, key=lambda r: r["place"])) == want
    tr.write_newick(tr.newick_rows(tree), str(tmp_path / "tree"))
    files = sorted((tmp_path / "tree").glob("part-*"))
    assert "".join(f.read_text() for f in files).replace("\n", "") == want


def test_newick_names_and_sizes(spark):
    import pytest

    tree = spark.createDataFrame([("a", None, "x(y):z;"), ("b", "a", None)], "child string, parent string, name string")
    assert tr.newick(tree).first()[0] == "(b:1)x_y__z_;" and tr.newick(tree, None).first()[0] == "(b)x_y__z_;"
    with pytest.raises(ValueError):
        tr.newick(tree, most_rows=1)
    assert tr.newick_rows(tree.limit(0)).collect() == []
    wide = spark.range(200_000).select(F.concat(F.lit("c"), "id").alias("child"), F.lit("root").alias("parent"), F.lit(None).cast("string").alias("name"))
    wide = wide.union(spark.sql("SELECT 'root', CAST(NULL AS STRING), 'r'"))
    sizes = tr.newick_rows(wide).agg(F.count(F.lit(1)), F.max(F.length("text")), F.max("place")).first()
    assert tuple(sizes) == (200_002, 10, 200_001)
