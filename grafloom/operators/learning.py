"""Learned results: walks and their embeddings, text embeddings, link prediction, node classification, temporal memories."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph, prop
from ..plans.lineage import shared_dir, written
from ..registry import register
from .centrality import ADJACENCY_EDGES


def walks(g: PropertyGraph, directed: bool, p: float, q: float, num_walks: int, walk_length: int, weight: str, seed: int) -> DataFrame:
    """(walk: ids as text): num_walks walks from each node; the next step's weight is divided by p back to the step before,
    and by q to what isn't its neighbour.  Walkers are spread over tasks that share the adjacency, which is size-checked."""
    e = g.E.select("src", "dst", g.weight(weight).alias("w"))
    if not directed:
        e = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    e = written(e.groupBy("src", "dst").agg(F.sum("w").alias("w")), "weights")
    n = e.count()
    if n > ADJACENCY_EDGES:
        raise ValueError(f"{n} edges exceed the {ADJACENCY_EDGES} that a task holds; take a subgraph")
    t = e.orderBy("src", "dst").toArrow()
    shared = g.spark.sparkContext.broadcast((t.column("src").to_numpy(), t.column("dst").to_numpy(), t.column("w").to_numpy()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        src, dst, w = shared.value
        near = lambda x: slice(*np.searchsorted(src, [x, x + 1]))
        for f in frames:
            out = []
            for start, turn in zip(f["id"], f["turn"], strict=True):
                rng = np.random.default_rng([seed, int(start) & 0xFFFFFFFF, int(turn)])
                walk = [int(start)]
                while len(walk) < walk_length:
                    s = near(walk[-1])
                    to, weights = dst[s], w[s].astype(float)
                    if not len(to):
                        break
                    if len(walk) > 1:
                        back, known = walk[-2], dst[near(walk[-2])]
                        weights = np.where(to == back, weights / p, np.where(np.isin(to, known), weights, weights / q))
                    walk.append(int(rng.choice(to, p=weights / weights.sum())))
                out.append([str(x) for x in walk])
            yield pd.DataFrame({"walk": out})

    start = g.V.select("id", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("turn"))
    return start.repartition(max(1, g.spark.sparkContext.defaultParallelism), "id", "turn").mapInPandas(run, "walk array<string>")


@register("node2vec.get_embeddings")
def node2vec(g: PropertyGraph, is_directed: bool = False, p: float = 2.0, q: float = 0.5, num_walks: int = 4, walk_length: int = 5, vector_size: int = 100, alpha: float = 0.025, window: int = 5, min_count: int = 1, seed: int = 1, workers: int = 1, min_alpha: float = 0.0001, sg: int = 1, hs: int = 0, negative: int = 5, epochs: int = 5, edge_weight_property: str = "weight") -> DataFrame:
    """(nodes, embeddings)."""
    found = written(walks(g, is_directed, p, q, num_walks, walk_length, edge_weight_property, seed), "walks")
    model = Word2Vec(vectorSize=vector_size, minCount=min_count, numPartitions=max(1, workers), stepSize=alpha, maxIter=epochs, seed=seed, windowSize=window, inputCol="walk", outputCol="v").fit(found)
    return model.getVectors().select(F.col("word").cast("long").alias("nodes"), vector_to_array("vector").alias("embeddings"))


@register("node2vec.set_embeddings", kind="write")
def set_embeddings(g: PropertyGraph, **options) -> PropertyGraph:
    found = node2vec(g, **options).select(F.col("nodes").alias("id"), F.col("embeddings").alias("embedding"))
    return PropertyGraph(g.V.drop("embedding").join(found, "id", "left"), g.E)


@register("node2vec.help")
def node2vec_help(g: PropertyGraph) -> DataFrame:
    return g.spark.createDataFrame([("get_embeddings", "an embedding of each node"), ("set_embeddings", "the graph with embeddings"), ("p", "how seldom a walk returns"), ("q", "how seldom a walk goes far")], "name string, value string")


EMBEDDING = {"model_name": "hashed-ngrams", "dimension": 256, "batch_size": 2000, "excluded_properties": [], "return_embeddings": False, "embedding_property": "embedding"}


def hashed_vector(text: str, dimension: int) -> np.ndarray:
    """Signed hashes of words and three-character pieces, of length one; takes the place of a model, none being at hand."""
    out = np.zeros(dimension)
    for w in re.findall(r"\w+", text.lower()):
        for piece in (w, *(f"^{w}$"[i : i + 3] for i in range(len(w)))):
            h = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "little")
            out[h % dimension] += 1 if h >> 63 else -1
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def _embedded(df: DataFrame, text, dimension: int, name: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def embed(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in s:
            yield part.map(lambda t: None if t is None else hashed_vector(t, dimension).tolist())

    return df.withColumn(name, embed(text))


@register("embeddings.model_info")
def model_info(g: PropertyGraph, configuration: dict | None = None) -> DataFrame:
    c = EMBEDDING | (configuration or {})
    return g.spark.createDataFrame([(k, str(v)) for k, v in c.items()], "name string, value string")


@register("embeddings.node_sentence", kind="write")
def node_sentence(g: PropertyGraph, input_nodes=None, configuration: dict | None = None) -> PropertyGraph:
    """The graph with an embedding of each node's sentence: its labels, then its properties as key: value.

    Embeddings are made where the nodes are; only which nodes are asked for is joined.
    """
    c = EMBEDDING | (configuration or {})
    pairs = F.transform(F.filter(F.array_sort(F.map_entries("props")), lambda e: ~e["key"].isin(*c["excluded_properties"], c["embedding_property"])), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    sentence = F.concat_ws(" ", F.array_join("labels", " "), F.array_join(pairs, " "))
    v = g.V.drop(c["embedding_property"])
    if input_nodes is not None:
        v = v.join(g._ids(input_nodes).withColumn("asked_", F.lit(True)), "id", "left")
        sentence = F.when(F.col("asked_"), sentence)
    v = _embedded(v.withColumn("sentence_", sentence), F.col("sentence_"), c["dimension"], c["embedding_property"])
    return PropertyGraph(v.drop("sentence_", "asked_"), g.E)


@register("embeddings.text")
def text_embeddings(g: PropertyGraph, input_strings: list[str], configuration: dict | None = None) -> DataFrame:
    """(text, embedding)."""
    c = EMBEDDING | (configuration or {})
    return _embedded(g.spark.createDataFrame([(t,) for t in input_strings], "text string"), F.coalesce("text", F.lit("")), c["dimension"], "embedding")


# ---- link prediction ---------------------------------------------------------------


@dataclass
class LinkSettings:
    target_relation: str = ""
    split_ratio: float = 0.8
    num_epochs: int = 50
    learning_rate: float = 0.01
    negatives: int = 1
    seed: int = 7
    context_save_dir: str = ""


@dataclass
class LinkState:
    settings: LinkSettings = field(default_factory=LinkSettings)
    model: PipelineModel | None = None
    results: list[tuple[str, str, float]] = field(default_factory=list)


LINK = LinkState()
LINK_FEATURES = ["common", "jaccard", "adamic", "degree1", "degree2"]


def link_features(g: PropertyGraph, pairs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with counts of common neighbours, Jaccard, Adamic-Adar and degrees, on the undirected view."""
    link = written(g.undirected().select("src", "dst").filter("src <> dst").distinct(), "links")
    deg = written(link.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("d")), "degree")
    pairs = written(pairs, "pairs")
    x = pairs.select("a", "b").distinct()
    near = x.join(link.select(F.col("src").alias("a"), F.col("dst").alias("n")), "a").join(link.select(F.col("src").alias("b"), F.col("dst").alias("n")), ["b", "n"])
    near = near.join(deg.select(F.col("id").alias("n"), "d"), "n").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("common"), F.sum(F.when(F.col("d") > 1, 1 / F.log("d")).otherwise(0.0)).alias("adamic"))
    out = pairs.join(near, ["a", "b"], "left").join(deg.select(F.col("id").alias("a"), F.col("d").alias("degree1")), "a", "left").join(deg.select(F.col("id").alias("b"), F.col("d").alias("degree2")), "b", "left").fillna(0.0, LINK_FEATURES[:1] + LINK_FEATURES[2:])
    either = F.col("degree1") + F.col("degree2") - F.col("common")
    return out.withColumn("jaccard", F.when(either <= 0, 0.0).otherwise(F.col("common") / either))


@register("link_prediction.set_model_parameters")
def set_link_parameters(g: PropertyGraph, parameters: dict) -> DataFrame:
    known = {f.name for f in fields(LinkSettings)}
    if wrong := set(parameters) - known:
        raise ValueError(f"no parameter named {', '.join(sorted(wrong))}")
    new = LinkSettings(**(asdict(LINK.settings) | parameters))
    if not 0 < new.split_ratio <= 1 or new.num_epochs < 1 or new.learning_rate <= 0:
        raise ValueError("split_ratio is within 0 and 1, and epochs and rate are positive")
    LINK.settings = new
    return g.spark.createDataFrame([("success", "")], "status string, message string")


@register("link_prediction.train")
def train_links(g: PropertyGraph) -> DataFrame:
    """(part, metric, value) on the training and the held-out edges; as many pairs without an edge are drawn by hash.

    Without a pair to learn from every pair is as likely as not; a measure of a part that has no pair is 0.
    """
    s = LINK.settings
    e = g.E.filter(F.col("type") == s.target_relation) if s.target_relation else g.E
    known = written(e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct(), "known")
    n = g.V.count()
    numbered = written(g.V.select("id", F.pmod(F.xxhash64("id", F.lit(s.seed)), F.lit(max(1, n))).alias("slot")), "slots")
    drawn = known.select(F.explode(F.sequence(F.lit(1), F.lit(s.negatives))).alias("k"), "a", "b").select("a", F.pmod(F.xxhash64("a", "b", "k", F.lit(s.seed)), F.lit(max(1, n))).alias("slot"))
    other = drawn.join(numbered.groupBy("slot").agg(F.min("id").alias("b")), "slot").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct().join(known, ["a", "b"], "left_anti")
    rows = known.withColumn("label", F.lit(1.0)).union(other.withColumn("label", F.lit(0.0)))
    rows = rows.withColumn("held", F.pmod(F.xxhash64("a", "b"), F.lit(1000)) >= int(1000 * s.split_ratio))
    # Features come from the graph without the held-out edges.
    hidden = rows.filter("held and label = 1").select("a", "b")
    seen = g.E.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst")).join(hidden, ["a", "b"], "left_anti").select(g.E.columns)
    data = written(link_features(PropertyGraph(g.V, seen), rows), "features")
    stages = [VectorAssembler(inputCols=LINK_FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features"), LogisticRegression(maxIter=s.num_epochs, labelCol="label")]
    learnt = data.filter("not held")
    if learnt.isEmpty():
        even = [(*[0.0] * len(LINK_FEATURES), y) for y in (0.0, 1.0)]
        learnt = g.spark.createDataFrame(even, ", ".join(f"{c} double" for c in [*LINK_FEATURES, "label"]))
    LINK.model = Pipeline(stages=stages).fit(learnt)
    if s.context_save_dir:
        LINK.model.write().overwrite().save(s.context_save_dir)
    scored = LINK.model.transform(data)
    rows = scored.groupBy("held").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), (F.sum(F.col("prediction") * F.col("label")) / F.sum("prediction")).alias("precision"), (F.sum(F.col("prediction") * F.col("label")) / F.sum("label")).alias("recall")).collect()
    of = {r["held"]: r for r in rows}
    LINK.results = [(part, m, float(held in of and of[held][m] or 0.0)) for part, held in (("training", False), ("validation", True)) for m in ("accuracy", "precision", "recall")]
    return get_training_results(g)


@register("link_prediction.get_training_results")
def get_training_results(g: PropertyGraph) -> DataFrame:
    if not LINK.results:
        raise ValueError("there was no training")
    return g.spark.createDataFrame(sorted(LINK.results), "part string, metric string, value double")


def _scores(g: PropertyGraph, pairs: DataFrame) -> DataFrame:
    if LINK.model is None:
        raise ValueError("train or load a model first")
    return LINK.model.transform(link_features(g, pairs)).withColumn("score", vector_to_array("probability")[1])


@register("link_prediction.predict")
def predict_link(g: PropertyGraph, src_vertex: int, dest_vertex: int) -> DataFrame:
    return _scores(g, g.spark.createDataFrame([(src_vertex, dest_vertex)], "a long, b long")).select("score")


@register("link_prediction.recommend")
def recommend(g: PropertyGraph, src_vertex: int, dest_vertices, k: int) -> DataFrame:
    """(score, recommendation): the k likeliest of dest_vertices."""
    pairs = g._ids(dest_vertices).select(F.lit(src_vertex).cast("long").alias("a"), F.col("id").alias("b"))
    return _scores(g, pairs).select("score", F.col("b").alias("recommendation")).orderBy(F.desc("score"), "recommendation").limit(k)


@register("link_prediction.load_model")
def load_link_model(g: PropertyGraph, path: str = "") -> DataFrame:
    LINK.model = PipelineModel.load(path or LINK.settings.context_save_dir)
    return g.spark.createDataFrame([("success",)], "status string")


@register("link_prediction.reset_parameters")
def reset_link_parameters(g: PropertyGraph) -> DataFrame:
    LINK.settings, LINK.model, LINK.results = LinkSettings(), None, []
    return g.spark.createDataFrame([("success",)], "status string")


# ---- node classification -------------------------------------------------------------

NODE_DEFAULTS = {"features_name": "features", "class_name": "class", "split_ratio": 0.8, "learning_rate": 0.1, "weight_decay": 5e-4, "num_epochs": 100, "path_to_model": ""}
NODE: dict = {"settings": dict(NODE_DEFAULTS), "model": None, "log": [], "saved": []}


@register("node_classification.set_model_parameters")
def set_node_parameters(g: PropertyGraph, params: dict | None = None) -> DataFrame:
    for k, v in (params or {}).items():
        if k not in NODE_DEFAULTS or not isinstance(v, type(NODE_DEFAULTS[k]) if not isinstance(NODE_DEFAULTS[k], float) else (int, float)):
            raise ValueError(f"{k} isn't a parameter of that type")
    NODE["settings"] |= params or {}
    return g.spark.createDataFrame([(k, str(v)) for k, v in NODE["settings"].items()], "name string, value string")


def node_features(g: PropertyGraph) -> DataFrame:
    """(id, x: a node's features and the mean of its neighbours'); a layer of message passing without weights."""
    c = NODE["settings"]
    p = prop(g.V, c["features_name"])
    kind = dict(g.V.select(p.alias("p")).dtypes)["p"]
    own = written(g.V.select("id", (F.from_json(p, "array<double>") if kind == "string" else p.cast("array<double>")).alias("f")).filter("f is not null"), "features")
    link = g.undirected().select("src", "dst").filter("src <> dst").distinct()
    cells = link.join(own.withColumnRenamed("id", "dst"), "dst").select("src", F.posexplode("f").alias("i", "x"))
    mean = cells.groupBy("src", "i").agg(F.avg("x").alias("x")).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m")).select(F.col("src").alias("id"), F.transform("m", lambda s: s["x"]).alias("m"))
    return own.join(mean, "id", "left").select("id", F.concat("f", F.coalesce("m", F.transform("f", lambda v: F.lit(0.0)))).alias("x"))


def _vector(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features_", array_to_vector("x"))


@register("node_classification.train")
def train_nodes(g: PropertyGraph, num_epochs: int = 100) -> DataFrame:
    """(epoch, loss, val_loss, train_log, val_log): the solver's losses, and accuracies at its end."""
    c = NODE["settings"]
    data = node_features(g).join(g.V.select("id", prop(g.V, c["class_name"], "string").alias("class_")).filter("class_ is not null"), "id")
    data = _vector(data).withColumn("held", F.pmod(F.xxhash64("id"), F.lit(1000)) >= int(1000 * c["split_ratio"]))
    model = Pipeline(stages=[StringIndexer(inputCol="class_", outputCol="y", handleInvalid="keep"), LogisticRegression(featuresCol="features_", labelCol="y", maxIter=num_epochs, regParam=c["weight_decay"])]).fit(data.filter("not held"))
    NODE["model"] = model
    acc = {r["held"]: r["a"] for r in model.transform(data).groupBy("held").agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("a")).collect()}
    history = list(model.stages[-1].summary.objectiveHistory)
    NODE["log"] = [(i, float(x), None, f"accuracy {acc.get(False)}" if i == len(history) - 1 else "", f"accuracy {acc.get(True)}" if i == len(history) - 1 else "") for i, x in enumerate(history)]
    return get_training_data(g)


@register("node_classification.get_training_data")
def get_training_data(g: PropertyGraph) -> DataFrame:
    return g.spark.createDataFrame(NODE["log"], "epoch long, loss double, val_loss double, train_log string, val_log string")


@register("node_classification.predict")
def predict_node(g: PropertyGraph, vertex) -> DataFrame:
    """(node, predicted_class)."""
    if NODE["model"] is None:
        raise ValueError("train or load a model first")
    names = NODE["model"].stages[0].labels
    rows = _vector(node_features(g).join(g._ids(vertex), "id", "left_semi")).withColumn("class_", F.lit(""))
    return NODE["model"].transform(rows).select(F.col("id").alias("node"), F.element_at(F.array(*map(F.lit, names)), F.col("prediction").cast("int") + 1).alias("predicted_class"))


@register("node_classification.save_model")
def save_node_model(g: PropertyGraph, keep: int = 5) -> DataFrame:
    """(path, status); the newest keep ones can be loaded."""
    if NODE["model"] is None:
        raise ValueError("there is no model")
    path = f"{NODE['settings']['path_to_model'] or shared_dir(g.spark)}/node-model-{len(NODE['saved'])}"
    NODE["model"].write().overwrite().save(path)
    NODE["saved"] = ([path] + NODE["saved"])[:keep]
    return g.spark.createDataFrame([(path, "saved")], "path string, status string")


@register("node_classification.load_model")
def load_node_model(g: PropertyGraph, num: int = 0) -> DataFrame:
    """The num-th newest."""
    if num >= len(NODE["saved"]):
        raise ValueError("there is no such model")
    NODE["model"] = PipelineModel.load(NODE["saved"][num])
    return g.spark.createDataFrame([(NODE["saved"][num], "loaded")], "path string, status string")


@register("node_classification.reset")
def reset_nodes(g: PropertyGraph) -> DataFrame:
    NODE.update({"settings": dict(NODE_DEFAULTS), "model": None, "log": [], "saved": []})
    return g.spark.createDataFrame([("success",)], "status string")


# ---- temporal memories ---------------------------------------------------------------

TGN_DEFAULTS = {"dimension": 32, "decay": 0.9, "batch_size": 200}
TGN: dict = {"settings": dict(TGN_DEFAULTS), "memory": None, "seen": 0, "results": [], "split": None}


def _signature(node: int, dimension: int) -> np.ndarray:
    return np.random.default_rng(int(node) & 0xFFFFFFFFFFFF).normal(0, 1 / np.sqrt(dimension), dimension)


@register("tgn.set_params")
def tgn_params(g: PropertyGraph, params: dict) -> None:
    if wrong := set(params) - set(TGN_DEFAULTS):
        raise ValueError(f"no parameter named {', '.join(sorted(wrong))}")
    TGN["settings"] = TGN_DEFAULTS | params
    TGN.update({"memory": None, "seen": 0, "results": [], "split": None})


@register("tgn.update")
def tgn_update(g: PropertyGraph, edges: DataFrame) -> None:
    """Let a micro-batch of edges (id, src, dst) pass: each end's memory is decayed and takes in what the other stands for.

    A node's memory is a decayed sum over its edges in order, so that the
    batch's part is one aggregate a node.
    """
    c = TGN["settings"]
    d, decay = c["dimension"], c["decay"]
    both = edges.select("id", F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("id", "dst", "src"))

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        m = np.zeros(d)
        for other in f["other"]:
            m = decay * m + _signature(other, d)
        return pd.DataFrame({"node": [f["node"].iloc[0]], "steps": [len(f)], "part": [m.tolist()]})

    part = both.groupBy("node").applyInPandas(fold, "node long, steps long, part array<double>")
    if TGN["memory"] is None:
        new = part.select("node", F.col("part").alias("embedding"))
    else:
        old = TGN["memory"]
        kept = F.when(F.col("steps").isNull(), F.col("embedding")).otherwise(F.zip_with(F.coalesce("embedding", F.transform("part", lambda v: F.lit(0.0))), F.col("part"), lambda a, b: a * F.pow(F.lit(decay), F.col("steps")) + b))
        new = old.join(part, "node", "full").select("node", kept.alias("embedding"))
    TGN["memory"], TGN["seen"] = written(new, "memory"), TGN["seen"] + 1


@register("tgn.get")
def tgn_get(g: PropertyGraph) -> DataFrame:
    """(node, embedding) of each node seen."""
    if TGN["memory"] is None:
        return g.spark.createDataFrame([], "node long, embedding array<double>")
    return TGN["memory"]


@register("tgn.predict_link_score")
def tgn_predict(g: PropertyGraph, src: int, dest: int) -> DataFrame:
    """(prediction): how far each memory points to what the other stands for, as a probability."""
    d = TGN["settings"]["dimension"]
    rows = {r["node"]: np.array(r["embedding"]) for r in tgn_get(g).filter(F.col("node").isin(src, dest)).collect()}
    zero = np.zeros(d)
    z = rows.get(src, zero) @ _signature(dest, d) + rows.get(dest, zero) @ _signature(src, d)
    return g.spark.createDataFrame([(float(1 / (1 + np.exp(-4 * (z - 0.5)))),)], "prediction double")


@register("tgn.set_eval")
def tgn_set_eval(g: PropertyGraph) -> DataFrame:
    TGN["split"] = g.E.agg(F.max("id")).first()[0]
    return g.spark.createDataFrame([("edges from here on are for evaluation",)], "message string")


@register("tgn.train_and_eval")
def tgn_train(g: PropertyGraph, num_epochs: int) -> DataFrame:
    """(epoch_num, batch_num, precision, batch_type): edges in order of id, those up to the split to learn from; an evaluated
    batch's precision is how often its edges score above pairs of its ends dealt anew."""
    if TGN["split"] is None:
        raise ValueError("call set_eval first")
    size, d = TGN["settings"]["batch_size"], TGN["settings"]["dimension"]
    edges = written(g.E.select("id", "src", "dst"), "edges")  # read by every batch
    for epoch in range(num_epochs):
        TGN["memory"] = None
        ordered = edges.orderBy("id")
        n_train = ordered.filter(F.col("id") <= TGN["split"]).count()
        n = ordered.count()
        bounds = sorted({0, n_train, n, *range(0, n_train, size), *range(n_train, n, size)})
        ids = [r["id"] for r in ordered.select("id").collect()]
        for b, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
            batch = edges.filter((F.col("id") >= ids[lo]) & (F.col("id") <= ids[hi - 1]))
            held = lo >= n_train
            rows = batch.collect() if held else []
            value = None
            if rows and TGN["memory"] is not None:
                memory = {r["node"]: np.array(r["embedding"]) for r in TGN["memory"].join(batch.select(F.col("src").alias("node")).union(batch.select("dst")).distinct(), "node", "left_semi").collect()}
                score = lambda a, c: memory.get(a, np.zeros(d)) @ _signature(c, d)  # noqa: B023, E731
                value = float(np.mean([score(r["src"], r["dst"]) > score(r["src"], rows[(i + 1) % len(rows)]["dst"]) for i, r in enumerate(rows)]))
            tgn_update(g, batch)
            TGN["results"].append((epoch, b, value, "EVAL" if held else "TRAIN"))
    return tgn_results(g)


@register("tgn.get_results")
def tgn_results(g: PropertyGraph) -> DataFrame:
    return g.spark.createDataFrame(TGN["results"], "epoch_num long, batch_num long, precision double, batch_type string")


@register("tgn.reset")
def tgn_reset(g: PropertyGraph) -> DataFrame:
    TGN.update({"settings": dict(TGN_DEFAULTS), "memory": None, "seen": 0, "results": [], "split": None})
    return g.spark.createDataFrame([("the memories are cleared",)], "message string")


@register("tgn.revert_from_database", "tgn.save_tgn_params")
def tgn_not_built(g: PropertyGraph) -> None:
    raise NotImplementedError("parameters are kept by the session")
