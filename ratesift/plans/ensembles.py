"""Ensembles trained on agreed ratings and applied to disputed ones."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ratesift.functions.scalars import r6
from ratesift.operators import category_noise as cat
from ratesift.operators import coherence_noise as coh
from ratesift.operators import consensus as con
from ratesift.operators import features as fea
from ratesift.operators import fuzzy_noise as fuz
from ratesift.operators import groupval as gv
from ratesift.operators import isolation as iso
from ratesift.operators import knn_classifier as knn
from ratesift.operators import learners as lea
from ratesift.operators import metrics as met
from ratesift.operators import selftraining as slf
from ratesift.operators.sampling import label_split
from ratesift.operators.stacking import VARIANTS, Stacking, repeated_fold_accuracy
from ratesift.plans.consensus import consensus
from ratesift.plans.evaluation import diversity, popular_recommendations
from ratesift.plans.registry import query
from ratesift.plans.relational import clusters
from ratesift.session import durable

def rating_id():
    """One number per (userId, itemId), for keys below two to the 31st."""
    return (F.col("userId") * F.lit(1 << 31) + F.col("itemId")).alias("id")


def stored_consensus(t):
    """The consensus table, written once per query."""
    if not hasattr(t, "consensus"):
        t.consensus = durable(consensus(t), "consensus")
    return t.consensus


def feature_table(t, extra=None, use_flags=True):
    table = stored_consensus(t)
    table = table if extra is None else extra(table)
    names = fea.VALIDATION_FEATURES if extra is not None else None
    return fea.with_features(table, fea.genre_names(t.items), use_flags, names)


def prepared(t):
    """Labelled and unlabelled rows with id, label, features, scaled and Fourier features."""
    rows = feature_table(t).select(rating_id(), "userId", "itemId", "label", "features")
    train, score = lea.scaled(con.labelled(rows), con.unlabelled(rows))
    width = len(fea.genre_names(t.items)) + len(fea.BASE) + len(fea.FLAG_FEATURES)
    return durable(lea.with_fourier(train, width), "train"), durable(lea.with_fourier(score, width), "score")


def verdict(df):
    return df.select("userId", "itemId", F.col("prediction").cast("int").alias("isNoisy"))


@query("k3_feature_table")
def feature_rows(t):
    return feature_table(t).select("userId", "itemId", F.size(vector_to_array("features")).alias("width"), "label")


def with_validation_deltas(t):
    """Add each user's cluster deltas: diversity against the complement, serendipity against the mean."""
    def add(table):
        train, _, recs = popular_recommendations(t)
        diverse = gv.diversity_by_cluster(diversity(t), clusters(t)).select("cluster", F.col("condition_1").alias("Delta_GV_Y"))
        per_user = met.user_serendipity(met.serendipity(recs, train))
        mean = per_user.agg(F.avg("serendipity")).scalar()
        surprise = per_user.join(clusters(t), "userId").groupBy("cluster").agg(
            (F.avg("serendipity")).alias("s")
        ).select("cluster", (F.col("s") - mean).alias("Delta_SERENDIPITY_X"))
        return table.join(clusters(t), "userId").join(diverse, "cluster").join(surprise, "cluster")

    return add


@query("k4_validated_feature_table")
def validated_feature_rows(t):
    rows = feature_table(t, with_validation_deltas(t))
    return rows.select("userId", "itemId", F.size(vector_to_array("features")).alias("width"), "label")


@query("k5_target_encoding")
def target_encoding(t):
    table = stored_consensus(t)
    model = fea.target_encoded().fit(con.labelled(table))
    return model.transform(con.unlabelled(table)).select("userId", "itemId", "genres", r6(F.col("genres_target")).alias("encoded"))


@query("l1_random_forest")
def random_forest(t):
    table = feature_table(t)
    model = lea.LEARNERS["forest"]().fit(con.labelled(table))
    return verdict(model.transform(con.unlabelled(table)))


@query("l2_validated_forest")
def validated_forest(t):
    """Forest on labels with validation deltas: accuracy, precision and recall on the held-out quarter."""
    rows = con.labelled(feature_table(t, with_validation_deltas(t)))
    split = durable(label_split(rows.select("userId", "itemId", "label", "features")), "split")
    model = lea.LEARNERS["forest"]().fit(split.where("is_train = 1"))
    return met.confusion(model.transform(split.where("is_train = 0")))


def _stacked(t, variant):
    train, score = prepared(t)
    return verdict(Stacking(VARIANTS[variant]).fit(train).predict(score))


@query("l3a_stacking_v1")
def stacking_v1(t):
    return _stacked(t, "v1")


@query("l3b_stacking_v2")
def stacking_v2(t):
    return _stacked(t, "v2")


@query("l3c_stacking_v3")
def stacking_v3(t):
    return _stacked(t, "v3")


@query("l3d_stacking_v4")
def stacking_v4(t):
    return _stacked(t, "v4")


@query("l4_stacking_accuracy")
def stacking_accuracy(t):
    """Held-out accuracy of a small stack."""
    train, _ = prepared(t)
    split = durable(label_split(train), "split")
    model = Stacking(("knn", "tree", "logistic")).fit(split.where("is_train = 1").drop("is_train"))
    return met.confusion(model.predict(split.where("is_train = 0").drop("is_train")))


KNN_COLUMNS = ["userId", "itemId", "rating", "ts", "nf1", "nf2", "nf3", "nf4"]
_Z = ", ".join(
    f"CASE WHEN s_{c} > 0 THEN (c.{c} - m_{c}) / s_{c} ELSE 0 END AS z{i}" for i, c in enumerate(KNN_COLUMNS)
)
_STATS = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in KNN_COLUMNS)
_DIST = " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(len(KNN_COLUMNS)))


@query("l5_knn_classifier", "consensus", f"""WITH st AS (SELECT {_STATS} FROM consensus WHERE label IS NOT NULL),
    z AS (SELECT c.userId, c.itemId, label, c.userId * 2147483648 + c.itemId AS id, {_Z} FROM consensus c, st)
    SELECT userId, itemId, CAST(avg(label) > 0.5 AS INT) AS isNoisy FROM (SELECT a.userId, a.itemId, b.label,
    row_number() OVER (PARTITION BY a.id ORDER BY round({_DIST}, 9), b.id) AS rn FROM z a, z b
    WHERE a.label IS NULL AND b.label IS NOT NULL) WHERE rn <= 5 GROUP BY 1, 2""")
def knn_classifier(t):
    table = stored_consensus(t)
    vec = knn.standardized(con.labelled(table), KNN_COLUMNS).alias("vec")
    rows = durable(table.select(rating_id(), "userId", "itemId", "label", vec), "knn")
    voted = knn.nearest_vote(con.labelled(rows), con.unlabelled(rows), "vec", 5)
    return voted.select("userId", "itemId", (F.col("p_noisy") > 0.5).cast("int").alias("isNoisy"))


@query("l6_boosting")
def boosting(t):
    """Boosted trees with the genre string as one target-encoded category."""
    table = stored_consensus(t)
    encode = fea.target_encoded().fit(con.labelled(table))
    columns = [*fea.BASE, *fea.FLAG_FEATURES, "genres_target"]
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")

    def assembled(rows):
        # The encoded genre is a number: its category list must not follow it into the trees.
        number = F.col("genres_target").alias("genres_target", metadata={})
        return assembler.transform(encode.transform(rows).select(*columns[:-1], number, "label"))

    train = durable(assembled(con.labelled(table)).select("features", "label"), "train")
    # Iterations, depth, rate and seed of the boosting run.
    model = GBTClassifier(labelCol="label", maxIter=100, maxDepth=6, stepSize=0.1, seed=1234, checkpointInterval=-1).fit(train)
    return verdict(model.transform(assembled(con.unlabelled(table))))


def isolation_scores(t):
    rows = con.unlabelled(stored_consensus(t)).withColumn(
        "genre", fea.genre_number(F.col("genres"), fea.genre_names(t.items)).cast("double")
    )
    vec = knn.standardized(rows, ["userId", "itemId", "rating", "ts", "genre"]).alias("vec")
    table = durable(rows.select(rating_id(), "userId", "itemId", vec), "isolation")
    return iso.score_forest(table, iso.fit_forest(table.select("id", "vec")))


@query("l7_isolation_forest")
def isolation_forest(t):
    return isolation_scores(t).select("userId", "itemId", "score", iso.anomaly_flag(F.col("score")).alias("isNoisy"))


@query("l8_anomaly_count", "f4", """SELECT CASE WHEN degree > 0.8 THEN 1 ELSE 0 END AS anomaly, count(*) AS n FROM f4 GROUP BY 1""")
def anomaly_count(t):
    return iso.anomaly_count(fuz.flag_fuzzy_noise(t.stored), "degree", iso.ANOMALY)


def _plain(t):
    rows = durable(feature_table(t).select("userId", "itemId", "label", "features"), "features")
    return con.labelled(rows), con.unlabelled(rows)


@query("l9_ressel")
def ressel(t):
    """Two self-trained learners; the code's vote is any."""
    labelled, unlabelled = _plain(t)
    models = slf.ressel(labelled, unlabelled, ("shallow_tree", "logistic"))
    return verdict(slf.predict_ensemble([m for m, _ in models], unlabelled))


@query("l10_robust_self_training")
def robust_self_training(t):
    labelled, unlabelled = _plain(t)
    (model, reached), = slf.ressel(labelled, unlabelled, ("bayes",))
    return verdict(slf.predict_ensemble([model], unlabelled)).withColumn("oob_accuracy", F.lit(reached))


@query("l11_confident_self_training")
def confident_self_training(t):
    labelled, unlabelled = _plain(t)
    model = slf.confident_self_training("logistic", labelled, unlabelled)
    return verdict(slf.predict_ensemble([model], unlabelled))


@query("l13_vote", "f1 f2 f4", """SELECT userId, itemId, greatest(nf1, nf2, nf4) AS any_vote,
    CASE WHEN (nf1 + nf2 + nf4) * 2 > 3 THEN 1 ELSE 0 END AS majority FROM f1 JOIN f2 USING (userId, itemId) JOIN f4 USING (userId, itemId)""")
def vote(t):
    flagged = fuz.flag_fuzzy_noise(coh.flag_coherence_noise(cat.flag_category_noise(t.stored), t.items))
    flags = [F.col(c) for c in ("nf1", "nf2", "nf4")]
    return flagged.select("userId", "itemId", slf.vote(flags).alias("any_vote"), slf.vote(flags, "majority").alias("majority"))


@query("l14_learner_set")
def learner_set(t):
    """Training accuracy of each learner of the semi-supervised set."""
    train, _ = prepared(t)
    results = []
    for name in ("bayes", "radial_svm", "shallow_tree", "logistic"):
        scored = lea.score(lea.LEARNERS[name]().fit(train), train, "p")
        results.append((F.lit(name), scored))
    results.append((F.lit("knn"), knn.NearestNeighbours(10).fit(train).score(train, "p")))
    parts = [
        df.agg(r6(F.avg(((F.col("p") > 0.5).cast("int") == F.col("label")).cast("int"))).alias("accuracy")).select(
            name.alias("learner"), "accuracy")
        for name, df in results
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total


@query("l15_repeated_folds")
def repeated_folds(t):
    train, _ = prepared(t)
    return repeated_fold_accuracy("tree", train)
