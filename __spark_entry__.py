"""

Derived doubles are rounded to six places on both sides, because float sums depend on order
in their last bits. Models have no SQL counterpart beyond a single split; whole runs are held
against what each of their steps must meet.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import standins as src  # noqa: E402
from sharewise.functions import clip_low  # noqa: E402
from sharewise.operators import (  # noqa: E402
    consistency,
    diversity,
    features,
    folds,
    importance,
    metadata,
    pairs,
    pareto,
    target,
)
from sharewise.plans import boosting, decorrelate, funding, runs, training  # noqa: E402
from sharewise.plans.features import (  # noqa: E402
    MISSING,
    TRAINING_FEATURES,
    numeric_columns,
    pair_features,
)
from sharewise.session import scratch_path, stage  # noqa: E402
from sharewise.sources import sinks, tables  # noqa: E402

try:  # the training-data operators are an optional part
    import corpus_pipeline
    from sharewise.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "sharewise.llm"):
        raise
    corpus_pipeline = llm = None

SMOKE_DIR = "/root/testdata/sf0.001"
KEY = ("id", "project_a", "project_b")
ALPHA = 0.001
#: Share of the one tree in ``first_diverse_round``.
FIRST_STEP = 0.3
#: A column of few values, for trees that SQL can grow too.
STUMP = "open_issues"


def rounded(df: DataFrame, keep=(), digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places; everything else, and ``keep``, as it is."""
    return df.select(
        *[
            F.round(c, digits).alias(c) if kind == "double" and c not in keep else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def _feature_frame(spark, sf):
    return pair_features(
        src.compared(spark, sf), src.dimension(spark, sf), src.AS_OF, mirrored=True
    )


def _features(*names, digits: int = 6):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(_feature_frame(spark, sf).select(*KEY, *names), digits=digits)

    return query


def _side_features(*names, digits: int = 6):
    """Features that belong to one side, ``names`` of both: rounded once per pair, then mirrored."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        df = pair_features(src.compared(spark, sf), src.dimension(spark, sf), src.AS_OF)
        df = rounded(df.select(*KEY, *names), digits=digits)
        return pairs.mirror_sides(df, features.decay_sides())

    return query


def rate_features(spark, sf):
    """Rates belong to a project: worked out and rounded once for it, looked up for both sides of
    a pair, then mirrored."""
    rates = features.project_rates(src.dimension(spark, sf), src.AS_OF)
    rated = metadata.attach_metadata(src.compared(spark, sf), rounded(rates, digits=15))
    names = [n + side for n in features.RATES for side in features.SIDES]
    return pairs.mirror_sides(features.dated_rates(rated).select(*KEY, *names))


def entry(spark: SparkSession) -> DataFrame:
    """Fit boosted trees on the training pairs' features and score the test pairs."""
    return gbt_submission(spark, SMOKE_DIR)


# --- pairs, metadata, joins --------------------------------------------------------------


def pair_ids(spark, sf):
    return pairs.strip_urls(src.all_pairs(spark, sf).drop("shipped"))


def project_universe(spark, sf):
    return pairs.project_universe(src.mirrored(spark, sf), src.test(spark, sf))


def missing_metadata(spark, sf):
    return metadata.missing_metadata(project_universe(spark, sf), src.dimension(spark, sf))


def pairs_with_metadata(spark, sf):
    return metadata.attach_metadata(
        src.compared(spark, sf), src.dimension(spark, sf), mirrored=True
    )


def pairs_with_metadata_folded(spark, sf):
    return metadata.attach_metadata(
        src.test(spark, sf), src.dimension(spark, sf), fold_case=True
    ).select(*KEY, "stars", "stars_b", "language", "language_b")


def pairs_with_metadata_folded_whole(spark, sf):
    """All pairs, with every column of the join."""
    return metadata.attach_metadata(
        src.compared(spark, sf), src.dimension(spark, sf), fold_case=True, mirrored=True
    )


def _doubled(spark, sf):
    """The dimension, with the archived projects recorded twice."""
    dim = src.dimension(spark, sf)
    return dim.unionByName(dim.filter("is_archived"))


def join_fanout_audit(spark, sf):
    return metadata.fanout_audit(src.compared(spark, sf), _doubled(spark, sf), mirrored=True)


def join_fanout_forecast(spark, sf):
    """The bound before the join next to the exact counts: it must not be below them, and with
    more cells than keys it is near."""
    pairs_, dim = src.mirrored(spark, sf), _doubled(spark, sf)
    exact = metadata.fanout_audit(pairs_, dim).select("rows_after_a", "rows_after_b")
    known = exact.select(F.struct("*")).scalar()
    bound = metadata.fanout_forecast(pairs_, dim)
    return bound.select(
        "rows_before",
        known["rows_after_b"].alias("rows_after_b"),
        (
            (F.col("most_after_a") >= known["rows_after_a"])
            & (F.col("most_after_b") >= known["rows_after_b"])
        ).alias("never_below"),
        (F.col("most_after_b") <= 1.5 * known["rows_after_b"]).alias("near"),
    )


# --- snapshots ---------------------------------------------------------------------------


def pairs_snapshot(spark, sf):
    """Raw CSV snapshots written, read back and cleaned."""
    train, test = tables.load_pairs(
        spark,
        scratch_path(spark, "raw"),
        lambda: src.raw_train(spark, sf),
        lambda: src.raw_test(spark, sf),
    )
    return train.select(*KEY, "weight_a").unionByName(test, allowMissingColumns=True)


def metadata_snapshot(spark, sf):
    """Metadata landed as JSON for the projects asked for, snapshot as Parquet, then topped up
    for projects that only the test pairs mention."""
    records = src.repo_metadata(spark, sf)

    def fetch(wanted: DataFrame) -> DataFrame:
        keys = wanted.select(F.lower("project").alias("key")).distinct()
        landed = scratch_path(spark, "landed")
        records.withColumn("key", F.lower("full_name")).join(keys, "key", "left_semi").drop(
            "key"
        ).write.json(landed)
        return tables.read_metadata_json(spark, landed)

    snapshot = scratch_path(spark, "metadata")
    trained = pairs.project_universe(src.train(spark, sf))
    tables.refresh_metadata(spark, snapshot, trained, fetch)
    return tables.refresh_metadata(spark, snapshot, project_universe(spark, sf), fetch)


def pair_quarantine(spark, sf):
    """Raw training lines of which some lost their id, spell it with letters or have a field too
    many, read with the malformed ones set apart: rows by outcome, and the weight that is left."""
    path, aside = scratch_path(spark, "lines"), scratch_path(spark, "quarantine")
    at = F.col("id")
    spoilt = src.raw_train(spark, sf).select(
        F.when(at % 97 == 0, F.concat(F.lit("x"), at)).when(at % 89 != 1, at.cast("string")).alias("id"),
        "project_a", "project_b", F.col("weight_a").cast("string").alias("weight_a"),
        F.concat(F.col("weight_b").cast("string"), F.when(at % 83 == 2, ",1").otherwise("")).alias("weight_b"),
    )
    spoilt.write.option("header", True).option("quote", "").csv(path)
    good, _ = tables.read_pairs_checked(spark, path, quarantine=aside)
    kept = good.agg(
        F.lit("good").alias("outcome"), F.count(F.lit(1)).alias("n_rows"),
        F.sum("weight_a").alias("weight"),
    )
    bad = spark.read.parquet(aside).groupBy(F.col("reason").alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(None).cast("double").alias("weight")
    )
    return rounded(kept.unionByName(bad))


def metadata_versions(spark, sf):
    """Metadata published three times: all projects, then records older than those, then newer
    ones of some. Of each project the newest record is left, whatever came last."""
    records, path = src.repo_metadata(spark, sf), scratch_path(spark, "versions")
    tables.merge_metadata(spark, path, records)
    stale = {"updated_at": F.col("created_at"), "stargazers_count": F.lit(-1).cast("bigint")}
    tables.merge_metadata(spark, path, records.withColumns(stale))
    fresh = {
        "updated_at": F.lit("2030-01-01T00:00:00Z"),
        "stargazers_count": F.col("stargazers_count") + 1000,
    }
    fetched = records.filter("size % 3 = 0").withColumns(fresh)
    final = tables.merge_metadata(spark, path, fetched)
    return final.select("full_name", "updated_at", "stargazers_count", "size")


# --- target encoding ---------------------------------------------------------------------


def target_encoding_holdout(spark, sf):
    train = src.mirrored_train(spark, sf)
    return rounded(target.target_encoding(src.test(spark, sf), train))


def target_encoding_loo(spark, sf):
    names = ("project_mean_weight_a", "project_mean_weight_b")
    return rounded(target.target_encoding(src.compared(spark, sf), mirrored=True).select(*KEY, *names))


def loo_values(spark, sf):
    return rounded(target.leave_one_out_values(src.mirrored(spark, sf), "a"))


def _weighted(spark, sf):
    """What the expanded encoding needs of the mirrored pairs, staged: rows and values are
    counted apart."""
    return stage(src.mirrored(spark, sf).select("id", "project_a", "weight_a"), "weighted")


def loo_expansion(spark, sf):
    return target.expansion_audit(_weighted(spark, sf), "a")


def expanded_stats(spark, sf):
    stats = target.expanded_stats(_weighted(spark, sf), "a")
    return rounded(stats.drop("n_both"), digits=4)


def expanded_summary(spark, sf):
    return rounded(target.expanded_summary(_weighted(spark, sf), "a"))


# --- funding -----------------------------------------------------------------------------


def funding_by_quarter(spark, sf):
    return funding.funding_by_quarter(src.oss_funding(spark, sf))


def funding_refresh(spark, sf):
    """The quarterly report kept up to date by two batches, the second with late facts of most
    quarters, and with the second written twice."""
    facts, path = stage(src.oss_funding(spark, sf), "facts"), scratch_path(spark, "funding")
    late = F.col("to_project_id") % 4 == 0
    funding.refresh_funding(spark, path, "first", facts.filter(~late))
    funding.refresh_funding(spark, path, "second", facts.filter(late))
    return funding.refresh_funding(spark, path, "second", facts.filter(late))


def top_repo(spark, sf):
    return funding.top_repo(src.repositories(spark, sf))


def funding_with_repo(spark, sf):
    return funding.funding_with_repo(src.oss_funding(spark, sf), src.repositories(spark, sf))


def funding_sql(spark, sf):
    """The same report by SQL over named tables, without forks: first each owner's starred
    repository, then the facts of owners that have one."""
    owners = tables.warehouse_query(
        spark,
        """SELECT project_id, max_by(artifact_url, (star_count, artifact_url)) AS project_repo
           FROM {repositories} GROUP BY project_id""",
        repositories=src.repositories(spark, sf).filter("NOT is_fork"),
    )
    return tables.warehouse_query(
        spark,
        """SELECT project_repo, date_trunc('quarter', time) AS quarter,
                  from_project_name AS funder, grant_pool_name, to_project_name AS project,
                  CAST(round(sum(amount)) AS BIGINT) AS total_funding_usd
           FROM {grants} JOIN {owners} ON project_id = to_project_id
           GROUP BY project_id, project_repo, quarter, funder, grant_pool_name, project""",
        grants=src.oss_funding(spark, sf),
        owners=owners,
    )


def repo_lookup(spark, sf):
    return funding.repo_lookup(src.repositories(spark, sf), src.LOOKUP_URLS)


# --- folds, metrics, comparison of models ------------------------------------------------


def _folded(spark, sf):
    return folds.assign_folds(src.mirrored(spark, sf))


def fold_assignment(spark, sf):
    return _folded(spark, sf).select(*KEY, "fold")


def equal_folds(spark, sf):
    return folds.assign_equal_folds(src.mirrored(spark, sf)).select(*KEY, "fold")


def fold_mse(spark, sf):
    return rounded(folds.fold_scores(folds.mean_baseline(_folded(spark, sf))))


def cv_summary(spark, sf):
    scores = folds.fold_scores(folds.mean_baseline(_folded(spark, sf)))
    return rounded(folds.score_summary(scores))


def error_diversity(spark, sf):
    return rounded(diversity.diversity_metric(src.scored_pairs(spark, sf)))


def _times_n(df, *names):
    """Terms of a mean, times the number of rows: rounding then tells rows apart at any size."""
    n = df.agg(F.count(F.lit(1))).scalar()
    return rounded(df.select("id", *[(F.col(c) * n).alias(c) for c in names]))


def _scored(spark, sf):
    """The scored pairs staged: their moments, their number and their rows are read apart."""
    names = ("id", "weight_a", "prediction", "base_prediction")
    return stage(src.scored_pairs(spark, sf).select(*names), "scored")


def diversity_gradient(spark, sf):
    scored = _scored(spark, sf)
    return _times_n(diversity.diversity_gradient(scored, ALPHA), "grad", "hess")


def diversity_hessian(spark, sf):
    scored = _scored(spark, sf)
    coded = diversity.diversity_gradient(scored, ALPHA, hessian="finite_difference")
    return _times_n(coded, "hess")


def gain_share(spark, sf):
    return rounded(importance.gain_share(src.feature_gain(spark, sf)))


def top_features(spark, sf):
    return importance.top_features(src.feature_gain(spark, sf))


def pareto_front(spark, sf):
    front = pareto.flag_overfit(pareto.pareto_front(src.model_points(spark, sf)), limit=25.0)
    return rounded(front.orderBy("mse"))


def submission(spark, sf):
    """Predictions on purpose outside 0..1: below it is floored, above it stays."""
    df = pair_features(src.test(spark, sf), src.dimension(spark, sf), src.AS_OF)
    share = F.coalesce(F.nanvl("stars_ratio", F.lit(None).cast("double")), F.lit(0.5))
    return sinks.submission(df.withColumn("prediction", share * 4.0 - 1.5))


# --- consistency -------------------------------------------------------------------------


def weight_sum_check(spark, sf):
    return rounded(consistency.weight_sum_check(src.mirrored(spark, sf)))


def mirror_check(spark, sf):
    """On the encoded weights, which unlike the raw ones do not mirror; default tolerance."""
    encoded = target.target_encoding(src.compared(spark, sf), mirrored=True)
    frame = encoded.select(*KEY, F.round("project_mean_weight_a", 6).alias("weight_a"))
    return rounded(consistency.mirror_violations(frame))


def triples(spark, sf):
    return rounded(consistency.triples(src.compared(spark, sf)))


def triple_check(spark, sf):
    return rounded(consistency.triple_summary(src.compared(spark, sf)))


# --- training ----------------------------------------------------------------------------


def _table(spark, sf, names=TRAINING_FEATURES):
    return training.training_table(
        src.train(spark, sf), src.dimension(spark, sf), src.AS_OF, names, mirrored=True
    )


def _selected(spark, sf):
    """The training table, the columns that a preliminary model selects from all 68, and the
    table cut into bins."""
    table = _table(spark, sf)
    binned = training.TableBins(table, TRAINING_FEATURES)
    selection = training.select_features(table, TRAINING_FEATURES, binned=binned)
    return table, training.selected_names(selection), binned


def gbt_cv(spark, sf):
    table, names, binned = _selected(spark, sf)
    return training.cross_validate(table, names, binned=binned)


def feature_selection(spark, sf):
    table = _table(spark, sf)
    return importance.ranked(training.select_features(table, TRAINING_FEATURES))


def random_search(spark, sf):
    table, names, binned = _selected(spark, sf)
    return training.random_search(table, names, binned=binned)


def gbt_submission(spark, sf):
    table, names, binned = _selected(spark, sf)
    model = training.fit(table, names, binned=binned)
    test = pair_features(src.test(spark, sf), src.dimension(spark, sf), src.AS_OF)
    return sinks.submission(training.predict(model, test, names))


def _base(spark, sf):
    """Base model on the selected columns: the training rows scored by it, the test rows, the
    columns and the model."""
    table, names, binned = _selected(spark, sf)
    model = training.fit(table, names, binned=binned)
    test = pair_features(src.test(spark, sf), src.dimension(spark, sf), src.AS_OF)
    rows = stage(numeric_columns(test, names, ["id"]), "test")
    return decorrelate.with_base(table, model), rows, names, model


def decorrelated_boost(spark, sf):
    scored, _, names, base = _base(spark, sf)
    model = decorrelate.boost_diverse(scored, names, ALPHA, base=base)
    keep = [training.LABEL, "base_prediction"]
    return diversity.diversity_metric(boosting.predict(scored, model, keep))


def _sweep(spark, sf):
    """Statistics and test scores of all eleven alphas."""
    scored, rows, names, base = _base(spark, sf)
    return decorrelate.sweep(scored, rows, names, base=base)


def alpha_sweep(spark, sf):
    return _sweep(spark, sf)[0]


def alpha_sweep_front(spark, sf):
    points = pareto.sweep_points(alpha_sweep(spark, sf))
    return pareto.flag_overfit(pareto.pareto_front(points)).orderBy("mse")


def alpha_submissions(spark, sf):
    """The sweep's predictions for the test pairs, written by alpha and read back."""
    stats, scores = _sweep(spark, sf)
    path = scratch_path(spark, "sweep")
    sinks.write_sweep(scores, stats, path)
    schema = "id bigint, pred double, alpha double"
    return spark.read.schema(schema).option("header", True).csv(f"{path}/submissions")


REGULARISED = {
    "rounds": 1, "num_leaves": 3, "learning_rate": 0.5, "min_child_samples": 100,
    "reg_alpha": 0.5, "reg_lambda": 4.0,
}
STUMP_ONLY = {"rounds": 1, "max_depth": 1, "learning_rate": 1.0, "min_child_samples": 1}


def first_tree(spark, sf):
    """One split of one column, gaps filled: small enough to be found again in SQL."""
    table = training.training_table(
        src.compared(spark, sf), src.dimension(spark, sf), src.AS_OF, [STUMP], mirrored=True
    )
    table = table.withColumn(STUMP, F.coalesce(F.col(STUMP), F.lit(MISSING)))
    model = training.fit(table, [STUMP], STUMP_ONLY)
    scored = training.predict(model, table, [STUMP], [STUMP])
    return _by_value(scored.withColumnRenamed(STUMP, "value"))


def first_diverse_round(spark, sf):
    """One split from zero under the diversity loss."""
    scored = src.scored_pairs(spark, sf, STUMP)
    keep = ["id", training.LABEL, "base_prediction"]
    table = numeric_columns(scored, [STUMP], keep)
    table = table.withColumn(STUMP, F.coalesce(F.col(STUMP), F.lit(MISSING)))
    table = stage(table, "first-round")
    params = STUMP_ONLY | {"learning_rate": FIRST_STEP}
    model = decorrelate.boost_diverse(table, [STUMP], ALPHA, params)
    return _by_value(boosting.predict(table, model, [STUMP]).withColumnRenamed(STUMP, "value"))


def _stump(spark, sf, params):
    """The label by the values of one column, gaps among them, as a small model predicts it."""
    table = training.training_table(
        src.compared(spark, sf), src.dimension(spark, sf), src.AS_OF, [STUMP], mirrored=True
    )
    model = training.fit(table, [STUMP], params)
    scored = training.predict(model, table, [STUMP], [STUMP])
    return _by_value(scored.withColumnRenamed(STUMP, "value"))


def first_gap_split(spark, sf):
    """One split of a column with gaps, which go to the side where they fit better."""
    return _stump(spark, sf, STUMP_ONLY)


def first_regularised_tree(spark, sf):
    """The best two splits of a column under regularisation, a least leaf and a leaf budget."""
    return _stump(spark, sf, REGULARISED)


def _by_value(scored):
    out = scored.groupBy("value").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("prediction").alias("prediction")
    )
    return rounded(out)


def _run(spark, sf):
    """A whole training run under a new folder."""
    table, path = _table(spark, sf), scratch_path(spark, "run")
    test = pair_features(src.test(spark, sf), src.dimension(spark, sf), src.AS_OF)
    runs.train_run(table, test, path)
    return table, test, path


def _step(name, df, n_rows, ok):
    return df.agg(
        F.lit(name).alias("step"),
        n_rows.cast("bigint").alias("n_rows"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
    )


def train_run(spark, sf):
    """A whole run, and what each of its steps must meet: shares add up and decide; settings
    lie in their ranges; every fold beats the mean of the others; every test pair has a
    prediction from 0 up; the saved model predicts what was submitted."""
    table, test, path = _run(spark, sf)
    n, every = F.count(F.lit(1)), F.bool_and
    share = F.col("gain_share")
    drawn = [
        F.col(name).cast("double").between(low, high)
        for name, (_, low, high) in training.SEARCH_SPACE.items()
    ]
    floor = folds.fold_scores(folds.mean_baseline(table)).select("fold", F.col("mse").alias("mean"))
    sent = spark.read.schema("id bigint, pred double").option("header", True)
    sent = sent.csv(f"{path}/submission")
    model, names, _ = sinks.load_run(spark, path)
    again = training.predict(model, test, names).select(
        "id", clip_low(F.col("prediction")).alias("again")
    )
    near = F.abs(F.col("pred") - F.col("again")) <= 1e-6
    steps = [
        _step(
            "selection", spark.read.json(f"{path}/features"), n,
            (F.abs(F.sum(share) - 1) < 1e-9)
            & every(F.col("selected") == (share > importance.MIN_SHARE)),
        ),
        _step(
            "search", spark.read.parquet(f"{path}/trials"), n,
            every(reduce(and_, drawn) & (F.col("mean_mse") > 0)),
        ),
        _step(
            "folds", spark.read.json(f"{path}/submission_metrics").join(floor, "fold"),
            F.sum("n_rows"), every(F.col("mse") < F.col("mean")),
        ),
        _step("submission", sent, n, every(F.col("pred").isNotNull() & (F.col("pred") >= 0))),
        _step("saved model", sent.join(again, "id"), n, every(near)),
    ]
    return reduce(DataFrame.unionByName, steps)


def sweep_run(spark, sf):
    """The sweep on a saved run: a row per alpha with its submission's size, whether that has a
    floored prediction for every pair, and whether the statistics can be."""
    table, test, path = _run(spark, sf)
    runs.sweep_run(table, test, path)
    sent = spark.read.schema("id bigint, pred double, alpha double").option("header", True)
    good = F.bool_and(F.col("pred").isNotNull() & (F.col("pred") >= 0))
    sent = sent.csv(f"{path}/sweep/submissions").groupBy("alpha").agg(
        F.count(F.lit(1)).alias("n_rows"), good.alias("submitted")
    )
    corr = F.abs(F.col("error_corr")) <= 1
    stats = spark.read.json(f"{path}/sweep/stats").select(
        "alpha", ((F.col("mse") > 0) & corr).alias("measured")
    )
    return sent.join(stats, "alpha")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    decayed = [
        features.decay_name(stem, side, label)
        for label in features.RATE_LABELS
        for stem in ("stars", "forks", "issues")
        for side in features.SIDES
    ]
    return {
        "pair_ids": pair_ids,
        "mirror_pairs": lambda spark, sf: src.mirrored(spark, sf),
        "project_universe": project_universe,
        "project_dim": lambda spark, sf: src.dimension(spark, sf),
        "missing_metadata": missing_metadata,
        "pairs_with_metadata": pairs_with_metadata,
        "pairs_with_metadata_folded": pairs_with_metadata_folded,
        "pairs_with_metadata_folded_whole": pairs_with_metadata_folded_whole,
        "join_fanout_audit": join_fanout_audit,
        "join_fanout_forecast": join_fanout_forecast,
        "pairs_snapshot": pairs_snapshot,
        "metadata_snapshot": metadata_snapshot,
        "metadata_versions": metadata_versions,
        "pair_quarantine": pair_quarantine,
        "temporal_features": _side_features(
            "created_dt", "updated_dt", "days_since_update", "age_days",
            "created_dt_b", "updated_dt_b", "days_since_update_b", "age_days_b",
        ),
        "decay_features": _side_features(*decayed),
        "interaction_features": _side_features(
            "stars_issues_interaction", "stars_issues_interaction_b",
            "forks_issues_interaction", "forks_issues_interaction_b",
            "stars_forks_interaction", "stars_forks_interaction_b",
            "engagement_score", "engagement_score_b",
        ),
        # Twelve places: shares with a denominator such as 640 end in exact halves at six.
        "ratio_features": _features(
            "stars_ratio", "watchers_ratio", "forks_ratio", "size_ratio", "issues_ratio",
            "subscribers_count_ratio", digits=12,
        ),
        "rate_features": rate_features,
        "log_features": _side_features(
            "log_stars", "log_stars_b", "log_watchers", "log_watchers_b", "log_forks",
            "log_forks_b",
        ),
        "target_encoding_holdout": target_encoding_holdout,
        "target_encoding_loo": target_encoding_loo,
        "loo_values": loo_values,
        "loo_expansion": loo_expansion,
        "expanded_stats": expanded_stats,
        "expanded_summary": expanded_summary,
        "funding_by_quarter": funding_by_quarter,
        "funding_refresh": funding_refresh,
        "top_repo": top_repo,
        "funding_with_repo": funding_with_repo,
        "funding_sql": funding_sql,
        "repo_lookup": repo_lookup,
        "fold_assignment": fold_assignment,
        "equal_folds": equal_folds,
        "fold_mse": fold_mse,
        "cv_summary": cv_summary,
        "error_diversity": error_diversity,
        "diversity_gradient": diversity_gradient,
        "diversity_hessian": diversity_hessian,
        "gain_share": gain_share,
        "top_features": top_features,
        "pareto_front": pareto_front,
        "submission": submission,
        "weight_sum_check": weight_sum_check,
        "mirror_check": mirror_check,
        "triples": triples,
        "triple_check": triple_check,
        "gbt_cv": gbt_cv,
        "feature_selection": feature_selection,
        "random_search": random_search,
        "gbt_submission": gbt_submission,
        "decorrelated_boost": decorrelated_boost,
        "alpha_sweep": alpha_sweep,
        "alpha_sweep_front": alpha_sweep_front,
        "alpha_submissions": alpha_submissions,
        "first_tree": first_tree,
        "first_diverse_round": first_diverse_round,
        "first_gap_split": first_gap_split,
        "first_regularised_tree": first_regularised_tree,
        "train_run": train_run,
        "sweep_run": sweep_run,
        **({} if llm is None else llm.queries() | {"pipeline": corpus_pipeline.run}),
    }


def oracle_sql() -> dict[str, str]:
    from oracle import texts

    return texts() | ({} if llm is None else llm.oracle_sql())
