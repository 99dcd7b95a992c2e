"""Random forest on Spark ML (training is distributed by Spark ML itself), stored as a
table of nodes and scored from it.

The forest being mirrored had 2 classes, 100 trees, at most 1000 nodes per tree
and split a leaf after 50 samples.  Spark ML has no node cap: ``maxDepth=9``
bounds a tree at 1023 nodes, ``minInstancesPerNode=25`` keeps each child at 25 or
more rows (a split of at least 50).  The class index is the label itself (no
one-hot pair).

    nodes(tree INT, node INT, feature INT, threshold DOUBLE, left INT, right INT, counts ARRAY<DOUBLE>)

A leaf has null feature, threshold and children; ``counts`` are the training rows of each
class that reached the node (weighted by their draws where rows were drawn).  A row goes
left where its feature's value is at most the threshold.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoclass.session import MAX_BROADCAST_CELLS, remove_path, scratch_path, written
from duoclass.sources.params_store import load_table, save_table

FOREST_PARAMS = dict(numTrees=100, maxDepth=9, minInstancesPerNode=25)
NODE_CELLS = 12   # 8-byte cells of a node that is broadcast, about


def _vec(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("_fv", array_to_vector(F.col(features).cast("array<double>")))


def forest_train(df: DataFrame, label: str = "label", features: str = "features", seed: int = 42,
                 **params) -> RandomForestClassificationModel:
    p = dict(FOREST_PARAMS)
    p.update(params)
    rf = RandomForestClassifier(featuresCol="_fv", labelCol="_y", seed=seed, **p)
    return rf.fit(_vec(df, features).withColumn("_y", F.col(label).cast("double")))


def forest_score(model: RandomForestClassificationModel, df: DataFrame, features: str = "features",
                 keep: list[str] | None = None) -> DataFrame:
    """Class probabilities -> argmax class (``pred``) and ``p1`` = P(class 1).

    A copy scores, as it holds no training summary: the summary goes to the tasks with its
    session, which can't be sent once ``DataFrame.observe`` was used in it.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != features]
    out = model.copy().transform(_vec(df, features))
    return out.select(*keep, F.col("prediction").cast("int").alias("pred"),
                      vector_to_array("probability")[1].alias("p1"))


def forest_summary(model: RandomForestClassificationModel) -> list[tuple[int, int, int]]:
    """(tree, nodes, depth) per tree - model-sized metadata."""
    return [(i, t.numNodes, t.depth) for i, t in enumerate(model.trees)]


def forest_nodes(spark: SparkSession, model: RandomForestClassificationModel) -> DataFrame:
    """A trained forest as its table of nodes, read from what Spark ML saves (a table itself)."""
    path = scratch_path(spark, "forest", model.uid)
    model.write().overwrite().save(path)
    d = F.col("nodeData")
    leaf = d["leftChild"] < 0
    inner = lambda c: F.when(~leaf, c)
    nodes = written(spark.read.parquet(f"{path}/data").select(
        F.col("treeID").cast("int").alias("tree"), d["id"].cast("int").alias("node"),
        inner(d["split"]["featureIndex"]).cast("int").alias("feature"),
        inner(d["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"),
        inner(d["leftChild"]).cast("int").alias("left"), inner(d["rightChild"]).cast("int").alias("right"),
        d["impurityStats"].alias("counts")), "forest-nodes")
    remove_path(spark, path)
    return nodes


def save_forest(spark: SparkSession, model: RandomForestClassificationModel, root: str, name: str, version: int) -> str:
    """Save a forest as a committed version of its node table."""
    nodes = forest_nodes(spark, model)
    path = save_table(nodes, root, name, version)
    remove_path(spark, nodes.written_path)
    return path


def load_forest(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    return load_table(spark, root, name, version).drop("model", "version")


def forest_descend(nodes: DataFrame, df: DataFrame, row_id: str, features: str = "features",
                   max_cells: int = MAX_BROADCAST_CELLS) -> DataFrame:
    """(row id, tree, node): the leaf that each row reaches in each tree.

    A tree is one row with its nodes in an array, and a row's path through it is a fold over
    at most as many steps as the tree is deep: rows meet trees in a broadcast join (beyond
    ``max_cells`` in a shuffled one) and nothing is shuffled per step.  A null or missing
    feature value goes right, as a comparison that isn't true.
    """
    order = F.sort_array(F.collect_list(F.struct("node", "feature", "threshold", "left", "right")))
    trees = nodes.groupBy("tree").agg(order.alias("nodes"))
    n_nodes = nodes.count()
    trees = F.broadcast(trees) if n_nodes * NODE_CELLS <= max_cells else trees
    ids = [r["tree"] for r in nodes.select("tree").distinct().collect()]
    rows = df.select(F.col(row_id), F.col(features).alias("_x"), F.explode(F.array(*map(F.lit, sorted(ids)))).alias("tree"))
    step = f"""aggregate(sequence(0, {nodes_depth(nodes)}), 0, (at, level) -> if(nodes[at].feature IS NULL, at,
              if(coalesce(get(_x, nodes[at].feature) <= nodes[at].threshold, false), nodes[at].left, nodes[at].right)))"""
    return rows.join(trees, "tree").select(row_id, "tree", F.expr(step).alias("node"))


def nodes_depth(nodes: DataFrame) -> int:
    """Depth of the deepest tree: levels walked from the roots until only leaves are left."""
    level = nodes.where("node = 0").select("tree", "node")
    children = nodes.where("feature IS NOT NULL").select("tree", "node", F.explode(F.array("left", "right")).alias("child"))
    depth = 0
    while True:
        level = level.join(children, ["tree", "node"]).select("tree", F.col("child").alias("node"))
        if level.isEmpty():
            return depth
        depth += 1


def forest_score_nodes(nodes: DataFrame, df: DataFrame, row_id: str, features: str = "features") -> DataFrame:
    """(row id, pred, p1) from the node table alone: mean over the trees of the class shares
    at the leaves; of equal classes the first wins."""
    shares = nodes.where("feature IS NULL").select("tree", "node", (F.get("counts", F.lit(1)) / F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)).alias("share"))
    met = forest_descend(nodes, df, row_id, features).join(shares, ["tree", "node"])
    p1 = met.groupBy(row_id).agg(F.avg("share").alias("p1"))
    return p1.select(row_id, (F.col("p1") > 0.5).cast("int").alias("pred"), "p1")
