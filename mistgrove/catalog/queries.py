"""One query per operator, each over whole tables of the given folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mistgrove.catalog.inputs import (
    CLASSES, CONSTANT, KEY, NOMINAL, NUMERIC, attributes, labelled, model_inputs, numeric_features, tidy,
)
from mistgrove.features import Feature, nominal
from mistgrove.functions import impurity as imp
from mistgrove.functions import membership as mem
from mistgrove.operators import bins as binning
from mistgrove.operators import cores as coring
from mistgrove.operators import cuts as cutting
from mistgrove.operators import describe, encode, evaluate, scale, score, splits, stats
from mistgrove.operators.route import at_root
from mistgrove.plans.evaluation import fit_and_evaluate
from mistgrove.plans.partitioning import fuzzy_partition
from mistgrove.plans.trees import ALLOWED, TreeModel, train_binary, train_multi
from mistgrove.sources import examples, reports
from mistgrove.sources.examples import read_table
from mistgrove.storage import settle, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def join_list(c: str):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


# ---- columns, codes, validation --------------------------------------------------------------


@query
def feature_min_max(spark, folder):
    """Least and greatest value of every numeric column."""
    return tidy(cutting.min_max(read_table(spark, folder, "lineitem"), NUMERIC))


@query
def class_map(spark, folder):
    """Distinct event types numbered in sorted order."""
    return tidy(cutting.class_map(read_table(spark, folder, "events"), "event_type"))


@query
def fit_metadata(spark, folder):
    """Sizes a partition search derives from the number of rows."""
    return tidy(cutting.fit_metadata(read_table(spark, folder, "lineitem"), 1000, 0.01))


@query
def constant_features(spark, folder):
    """Nominal columns with a single value."""
    found = encode.constant_features(attributes(spark, labelled(spark, folder)))
    return tidy(found.select("idx", "name", join_list("values").alias("listing")))


@query
def encode_and_drop(spark, folder):
    """Rows with codes for nominals and without constant columns."""
    df = labelled(spark, folder)
    declared = attributes(spark, df)
    encoded = encode.encode_examples(df, declared)
    kept, _ = encode.drop_features(encoded, declared, encode.constant_features(declared))
    return tidy(kept.select(*KEY, *NOMINAL, "cls"))


@query
def reindexed_features(spark, folder):
    """Attributes renumbered after the constant ones are dropped."""
    df = labelled(spark, folder)
    declared = attributes(spark, df)
    _, rest = encode.drop_features(df, declared, encode.constant_features(declared))
    return tidy(rest.select("idx", "name", "kind"))


@query
def rule_violations(spark, folder):
    """Rows breaking each validation rule, with one category and one class declared too few."""
    df, features = model_inputs(spark, folder)
    narrowed = [nominal(f.name, f.arity - 1) if f.kind == "nominal" else f for f in features]
    return tidy(encode.violations(df, narrowed, "cls", CLASSES - 1).drop("rows"))


# ---- fuzzy sets and t-norms ------------------------------------------------------------------


@query
def uniform_cores(spark, folder):
    """Evenly spaced cores on [0, 1] for every numeric column."""
    names = cutting.min_max(read_table(spark, folder, "lineitem"), NUMERIC)
    return tidy(binning.uniform_cores_table(names, 5))


@query
def triangular_partition(spark, folder):
    """Triangles over the distinct discounts and taxes that occur."""
    df = read_table(spark, folder, "lineitem")
    cores = scale.melt(df, ["l_discount", "l_tax"], {"l_discount": [], "l_tax": []})
    return tidy(mem.triangular_partition(cores.withColumnRenamed("value", "core")))


@query
def singleton_partition(spark, folder):
    """Singletons over the codes of the nominal columns."""
    declared = attributes(spark, labelled(spark, folder)).filter("kind = 'nominal'")
    arities = declared.select(F.col("name").alias("feature"), F.size("values").alias("arity"))
    return tidy(mem.singleton_partition(arities))


@query
def fuzzy_sets(spark, folder):
    """Every fuzzy set of the model inputs."""
    return tidy(binning.partition_table(spark, model_inputs(spark, folder)[1]))


@query
def triangular_sets(spark, folder):
    """A triangle from three columns of every part, in whatever order they come."""
    p = read_table(spark, folder, "part").withColumn("size", F.col("p_size").cast("double"))
    cut = mem.triangular_set(F.col("p_retailprice"), F.col("size") * 20, F.lit(1000.0))
    return tidy(p.select("p_partkey", cut.alias("t")).select("p_partkey", "t.a", "t.b", "t.c"))


def _prices_with_sets(spark, folder) -> DataFrame:
    df = read_table(spark, folder, "orders")
    features = numeric_features(df, ["o_totalprice"])
    return df.select("o_orderkey", F.col("o_totalprice").alias("x"), F.inline(binning.sets_of(features[0])))


@query
def membership_triangular(spark, folder):
    """Membership of every order's price in each of five triangles."""
    fuzzy = _prices_with_sets(spark, folder)
    mu = mem.triangular_membership(F.col("x"), F.col("a"), F.col("b"), F.col("c"))
    return tidy(fuzzy.select("o_orderkey", "bin", mu.alias("mu")))


@query
def in_support(spark, folder):
    """Whether every order's price lies in the support of each of five triangles."""
    fuzzy = _prices_with_sets(spark, folder)
    return tidy(fuzzy.select("o_orderkey", "bin", mem.in_support(F.col("x"), F.col("a"), F.col("c")).alias("inside")))


@query
def membership_singleton(spark, folder):
    """Membership of every row's return flag code in each of its categories."""
    df, features = model_inputs(spark, folder)
    flag = next(f for f in features if f.name == "l_returnflag")
    opened = df.select(*KEY, F.col("l_returnflag").cast("double").alias("x"), F.inline(binning.sets_of(flag)))
    return tidy(opened.select(*KEY, "bin", mem.singleton_membership(F.col("x"), F.col("b")).alias("mu")))


@query
def binned_rows(spark, folder):
    """Fired bins and memberships of every row in every column."""
    df, features = model_inputs(spark, folder)
    key = [F.col(c).alias(f"k{i}") for i, c in enumerate(KEY)]
    names = [f"k{i}" for i in range(len(KEY))]
    binned = binning.bin_features(df, features, *key)
    pairs = [F.struct(F.lit(f.name).alias("feature"), F.col(f.name).alias("fired")) for f in features]
    opened = binned.select(*names, F.inline(F.array(*pairs))).select(*names, "feature", F.inline("fired"))
    return tidy(opened)


@query
def tnorm_pairs(spark, folder):
    """Both t-norms of two memberships of every row."""
    df = read_table(spark, folder, "lineitem")
    features = numeric_features(df, ["l_quantity", "l_extendedprice"])
    rows = binning.with_coords(df, features, *KEY)
    up = [binning.upper_degree(F.get("coords", F.lit(i))) for i in range(2)]
    return tidy(rows.select(
        *KEY, mem.tnorm_product(*up).alias("product"), mem.tnorm_min(*up).alias("least")
    ))


# ---- impurities ------------------------------------------------------------------------------


def _flag_counts(spark, folder) -> DataFrame:
    """Class counts of every (return flag, line status)."""
    df = labelled(spark, folder)
    counts = [F.count_if(F.col("cls") == j).cast("double") for j in range(CLASSES)]
    return df.groupBy("l_linenumber", "l_returnflag", "l_linestatus").agg(F.array(*counts).alias("counts"))


@query
def entropy_by_group(spark, folder):
    """Entropy of the class counts of every group."""
    c = _flag_counts(spark, folder)
    return tidy(c.select("l_linenumber", "l_returnflag", "l_linestatus", imp.entropy(F.col("counts")).alias("bits")))


@query
def weighted_impurity(spark, folder):
    """Mean entropy of the groups of every line number, weighted by size."""
    c = _flag_counts(spark, folder).groupBy("l_linenumber").agg(
        F.collect_list("counts").alias("sets"), F.sum(imp.array_total(F.col("counts"))).alias("n")
    )
    return tidy(c.select("l_linenumber", "n", imp.weighted_impurity(F.col("sets"), F.col("n")).alias("bits")))


@query
def node_measures(spark, folder):
    """Purity, shares, size and single-class flag of every group's class counts."""
    c = _flag_counts(spark, folder)
    shares = imp.class_shares(F.col("counts"))
    return tidy(c.select(
        "l_linenumber", "l_returnflag", "l_linestatus",
        imp.node_purity(F.col("counts")).alias("purity"), imp.array_total(F.col("counts")).alias("total"),
        imp.is_mono_label(F.col("counts")).alias("mono"),
        *[F.get(shares, F.lit(j)).alias(f"share{j}") for j in range(CLASSES)],
    ))


@query
def category_subsets(spark, folder):
    """The categories named by the bits of every part's size."""
    p = read_table(spark, folder, "part")
    subset = imp.category_subset(F.col("p_size"), F.lit(6))
    return tidy(p.select("p_partkey", "p_size", F.array_join(F.transform(subset, lambda v: v.cast("string")), ",").alias("listing")))


# ---- quantiles and scaling -------------------------------------------------------------------


@query
def exact_quantiles(spark, folder):
    """The thousand exact quantiles of every numeric column."""
    return tidy(scale.exact_quantiles(read_table(spark, folder, "lineitem"), NUMERIC))


@query
def uniform_scale(spark, folder):
    """Every numeric column mapped to a uniform distribution by its exact quantiles."""
    df = read_table(spark, folder, "lineitem")
    quantiles = scale.quantile_lists(scale.exact_quantiles(df, NUMERIC))
    lower = {r.feature: r.lo for r in cutting.min_max(df, NUMERIC).collect()}
    keyed = df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").alias("price"), *NUMERIC)
    return tidy(scale.to_uniform(keyed, quantiles, lower))


# ---- cuts and contingency --------------------------------------------------------------------

WIDTH_SPLITS, FREQUENCY_SPLITS = 31, 15


@query
def equi_width_cuts(spark, folder):
    """Evenly spaced cuts of every numeric column."""
    df = read_table(spark, folder, "lineitem")
    return tidy(cutting.equi_width_cuts(cutting.min_max(df, NUMERIC), WIDTH_SPLITS))


@query
def equi_frequency_cuts(spark, folder):
    """Equal-frequency cuts of every numeric column within every line number."""
    df = read_table(spark, folder, "lineitem")
    found = cutting.equi_frequency_cuts(df, NUMERIC, FREQUENCY_SPLITS, "l_linenumber")
    return tidy(found.distinct())


@query
def merged_cuts(spark, folder):
    """The same cuts merged over the line numbers."""
    df = read_table(spark, folder, "lineitem")
    return tidy(cutting.candidate_cuts(df, NUMERIC, cutting.EQUAL_FREQUENCY, FREQUENCY_SPLITS, "l_linenumber"))


@query
def sampled_cuts(spark, folder):
    """Evenly spaced cuts from a sample of the rows."""
    df = read_table(spark, folder, "lineitem")
    return tidy(cutting.candidate_cuts(df, NUMERIC, cutting.EQUAL_WIDTH, WIDTH_SPLITS, fraction=0.5, sample_key=KEY[:4]))


def _counts(spark, folder, strategy: str) -> tuple[DataFrame, DataFrame]:
    df = labelled(spark, folder)
    splits_ = WIDTH_SPLITS if strategy == cutting.EQUAL_WIDTH else FREQUENCY_SPLITS
    found = cutting.candidate_cuts(df, NUMERIC, strategy, splits_, "l_linenumber")
    return found, cutting.contingency_between(df, "cls", found, NUMERIC, strategy, df.count())


@query
def contingency_width(spark, folder):
    """Class counts between evenly spaced cuts."""
    return tidy(_counts(spark, folder, cutting.EQUAL_WIDTH)[1])


@query
def contingency_freq(spark, folder):
    """Class counts between merged equal-frequency cuts."""
    return tidy(_counts(spark, folder, cutting.EQUAL_FREQUENCY)[1])


@query
def contingency_ranked(spark, folder):
    """The same by the rank join that serves any number of cuts, which are numbered range by range too."""
    df = labelled(spark, folder)
    cuts = cutting.merge_cuts(cutting.equi_frequency_cuts(df, NUMERIC, FREQUENCY_SPLITS, "l_linenumber"), most=50)
    return tidy(cutting.rank_join(df, "cls", cuts, NUMERIC, df.count(), buckets=16))


def _searchable(spark, folder) -> DataFrame:
    return coring.searchable_bins(*_counts(spark, folder, cutting.EQUAL_WIDTH), CLASSES)


@query
def range_counts(spark, folder):
    """Class counts of the bins 5 to 19 of every column."""
    return tidy(coring.range_counts(_searchable(spark, folder), 5, 20))


@query
def cardinality_two(spark, folder):
    """Class cardinality of two end sets over all searchable bins."""
    sums = coring.two_sets(coring.segment_sums(_searchable(spark, folder).withColumn("seg", F.lit(0))))
    return tidy(sums.filter("bin = 0").select("feature", "label", "t0", "t1"), 4)


@query
def cardinality_three(spark, folder):
    """Class cardinality of three sets for every candidate middle core."""
    sums = coring.three_sets(coring.segment_sums(_searchable(spark, folder).withColumn("seg", F.lit(0))))
    return tidy(sums.filter("p > 0").select("feature", "bin", "label", "s0", "s1", "s2"), 4)


@query
def first_core(spark, folder):
    """The first core the entropy search accepts in every column."""
    found = coring.best_cores(_searchable(spark, folder).withColumn("seg", F.lit(0)), True, 0, 1e-6)
    return tidy(found.select("feature", "core", "gain"))


@query
def fuzzy_partition_width(spark, folder):
    """The full supervised partition from evenly spaced candidates."""
    found = fuzzy_partition(
        labelled(spark, folder), NUMERIC, "cls", CLASSES, cutting.EQUAL_WIDTH, max_bins=WIDTH_SPLITS + 1
    )
    return tidy(found.select("feature", F.posexplode_outer("cores").alias("bin", "core")))


@query
def fuzzy_partition_freq(spark, folder):
    """The full supervised partition from equal-frequency candidates, at least 5% of rows per side."""
    found = fuzzy_partition(
        labelled(spark, folder), NUMERIC, "cls", CLASSES, cutting.EQUAL_FREQUENCY,
        max_bins=FREQUENCY_SPLITS + 1, block="l_linenumber", min_ratio=0.05,
    )
    return tidy(found.select("feature", F.posexplode_outer("cores").alias("bin", "core")))


@query
def partition_stats(spark, folder):
    """Sizes of the supervised partition."""
    found = fuzzy_partition(
        labelled(spark, folder), NUMERIC, "cls", CLASSES, cutting.EQUAL_WIDTH, max_bins=WIDTH_SPLITS + 1
    )
    return tidy(describe.partition_stats(found))


@query
def partition_listing(spark, folder):
    """Cores of the distinct discounts and taxes as text."""
    df = read_table(spark, folder, "lineitem")
    values = scale.melt(df, ["l_discount", "l_tax"], {"l_discount": [], "l_tax": []})
    return describe.partition_listing(values.groupBy("feature").agg(F.collect_set("value").alias("cores")))


# ---- statistics and splits of a node ---------------------------------------------------------


def _root_stats(spark, folder, binary: bool = False) -> tuple[DataFrame, list[Feature]]:
    df, features = model_inputs(spark, folder)
    rows = at_root(binning.with_coords(df, features, F.col("cls").alias("label")), "label")
    rows = rows.withColumns({
        "used": F.array().cast("array<int>"), "allowed": F.create_map().cast(ALLOWED),
    })
    return settle(stats.node_stats(rows, binary=binary)), features  # read more than once


def _root_node(root_stats: DataFrame, classes: int = CLASSES) -> DataFrame:
    return stats.node_predict(root_stats, classes).withColumn("allowed", F.create_map().cast(ALLOWED))


@query
def node_stats_root(spark, folder):
    """Membership sums and counts per column, bin and class at the root."""
    found, _ = _root_stats(spark, folder)
    return tidy(found.drop("node_id"), u=3)


@query
def node_predict_root(spark, folder):
    """Class memberships, counts and impurity of the root."""
    found = stats.node_predict(_root_stats(spark, folder)[0], CLASSES)
    return tidy(found.select("impurity", F.posexplode(F.arrays_zip("u", "freq")).alias("label", "z")).select(
        "impurity", "label", "z.u", "z.freq"
    ), u=3)


@query
def multi_gains(spark, folder):
    """Gain of splitting the root on every column."""
    found, _ = _root_stats(spark, folder)
    return tidy(splits.multi_gains(found, _root_node(found), CLASSES, 1e-6).select("feature", "gain"))


@query
def best_split_multi(spark, folder):
    """The column that best separates the classes, its gain and the class mix of its fuzzy sets."""
    found, features = _root_stats(spark, folder)
    best = splits.best_split_multi(found, _root_node(found), CLASSES)
    names = F.array(*[F.lit(f.name) for f in features])
    opened = best.select(F.get(names, F.col("feature")).alias("feature"), "gain", F.explode("parts").alias("bin", "part"))
    shares = imp.class_shares(F.col("part.u"))
    return tidy(opened.select(
        "feature", "gain", "bin", *[F.get(shares, F.lit(j)).alias(f"share{j}") for j in range(CLASSES)]
    ))


@query
def bin_plan(spark, folder):
    """How a binary tree would split the columns of customer, orders and lineitem."""
    parts = []
    for table, column in (("lineitem", "l_returnflag"), ("orders", "o_orderpriority"), ("customer", "c_mktsegment"),
                          ("part", "p_size"), ("nation", "n_name")):
        counted = read_table(spark, folder, table).agg(F.count_distinct(column).cast("int").alias("bins"))
        parts.append(counted.select(F.lit(column).alias("feature"), F.lit("nominal").alias("kind"), "bins"))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return tidy(splits.bin_plan(union, CLASSES, 32))


@query
def subset_splits(spark, folder):
    """Every way to part the order priorities in two."""
    arity = read_table(spark, folder, "orders").agg(F.count_distinct("o_orderpriority").cast("int").alias("bins"))
    found = splits.subset_splits(arity.withColumn("feature", F.lit(0)))
    return tidy(found.select("feature", "split", join_list("left_bins").alias("listing")))


@query
def allowed_bins(spark, folder):
    """Bins left for either side of every subset split of the order priorities."""
    arity = read_table(spark, folder, "orders").agg(F.count_distinct("o_orderpriority").cast("int").alias("bins"))
    found = splits.subset_splits(arity.withColumn("feature", F.lit(0)))
    full = F.sequence(F.lit(0), F.lit(4))
    left, right = splits.allowed_bins(full, F.col("left_bins"))
    return tidy(found.select("split", left.alias("l"), right.alias("r")).select(
        "split", join_list("l").alias("left"), join_list("r").alias("right")
    ))


def _binary_root(spark, folder, kind: str) -> DataFrame:
    found, features = _root_stats(spark, folder, binary=True)
    gains = splits.candidate_gains_binary(found, _root_node(found), features, CLASSES, 32, 1e-6, (kind,))
    return tidy(gains.select("feature", "split", join_list("left_bins").alias("listing"), "gain"))


@query
def binary_split_numeric(spark, folder):
    """Gain of every cut between the fuzzy sets of the numeric columns."""
    return _binary_root(spark, folder, "numeric")


@query
def binary_split_unordered(spark, folder):
    """Gain of every category subset of the nominal columns."""
    return _binary_root(spark, folder, "unordered")


def _customer_nodes(spark, folder) -> tuple[DataFrame, list[Feature]]:
    """Customers: is the balance above 5000, by market segment and nation."""
    df = read_table(spark, folder, "customer").withColumn("label", (F.col("c_acctbal") > 5000).cast("int"))
    segments = [r[0] for r in df.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    coded = df.withColumn("c_mktsegment", encode.code_of(F.col("c_mktsegment"), segments))
    features = [nominal("c_mktsegment", len(segments)), nominal("c_nationkey", 25)]
    rows = at_root(binning.with_coords(coded, features, "label"), "label")
    return settle(stats.node_stats(rows.withColumn("allowed", F.create_map().cast(ALLOWED)), binary=True)), features


@query
def binary_split_ordered(spark, folder):
    """Gain of every cut along the ordered categories in a two-class problem."""
    found, features = _customer_nodes(spark, folder)
    gains = splits.candidate_gains_binary(found, _root_node(found, 2), features, 2, 32, 1e-6, ("ordered",))
    return tidy(gains.select("feature", "split", join_list("left_bins").alias("listing"), "gain"))


@query
def order_categories(spark, folder):
    """Order of the nations and segments by the impurity of three balance classes."""
    df = read_table(spark, folder, "customer").withColumn(
        "label", F.when(F.col("c_acctbal") < 1000, 0).when(F.col("c_acctbal") < 6000, 1).otherwise(2)
    )
    features = [nominal("c_nationkey", 25)]
    rows = at_root(binning.with_coords(df, features, "label"), "label")
    found = settle(stats.node_stats(rows.withColumn("allowed", F.create_map().cast(ALLOWED)), binary=True))
    all_slots = splits.slots(found, _root_node(found), features, CLASSES, 8)
    return tidy(splits.order_categories(all_slots, CLASSES).select("feature", "bin", "rank"))


@query
def running_bins(spark, folder):
    """Class sums on both sides of every cut of the numeric columns."""
    found, features = _root_stats(spark, folder, binary=True)
    all_slots = splits.slots(found, _root_node(found), features, CLASSES, 32).filter("kind = 'numeric'")
    sides = splits.running_bins(all_slots, CLASSES)
    return tidy(sides.drop("node_id", "left_bins"), l_u=3, r_u=3)


# ---- trees -----------------------------------------------------------------------------------

DEPTH = 3


def _multi_tree(spark, folder) -> tuple[DataFrame, TreeModel]:
    df, features = model_inputs(spark, folder)
    return df, train_multi(df, features, "cls", CLASSES, max_depth=DEPTH)


def _binary_tree(spark, folder, tnorm: str = "product") -> tuple[DataFrame, TreeModel]:
    df, features = model_inputs(spark, folder)
    return df, train_binary(df, features, "cls", CLASSES, tnorm=tnorm, max_depth=DEPTH)


def _node_rows(model: TreeModel) -> DataFrame:
    per_class = [F.get("u", F.lit(j)).alias(f"u{j}") for j in range(model.classes)]
    found = model.nodes.select(
        "node_id", "parent_id", "level", "split_feature", "is_leaf", "gain", "impurity",
        imp.array_total(F.col("freq")).alias("freq"), *per_class,
        *([join_list("left_bins").alias("listing")] if model.kind == "binary" else []),
    )
    return tidy(found, u0=3, u1=3, u2=3)


def _scores(df: DataFrame, model: TreeModel) -> DataFrame:
    scored = score.score_table(df, model, KEY)
    each = [F.get("scores", F.lit(j)).alias(f"score{j}") for j in range(model.classes)]
    return tidy(scored.select(*KEY, *each, "prediction"))


@query
def multi_tree_nodes(spark, folder):
    """All nodes of a multi-way tree of depth three."""
    return _node_rows(_multi_tree(spark, folder)[1])


@query
def multi_scores(spark, folder):
    """Class confidences and predicted class of every row by that tree."""
    return _scores(*_multi_tree(spark, folder))


@query
def multi_scores_staged(spark, folder):
    """The same in stages of a few nodes, as used for trees too large to send out whole."""
    df, model = _multi_tree(spark, folder)
    scored = score.score_table(df, model, KEY, stage_nodes=20)
    return tidy(score.score_rows(scored, *KEY))


@query
def binary_tree_nodes(spark, folder):
    """All nodes of a binary tree of depth three."""
    return _node_rows(_binary_tree(spark, folder)[1])


@query
def binary_tree_nodes_min(spark, folder):
    """The same with the minimum as t-norm."""
    return _node_rows(_binary_tree(spark, folder, "min")[1])


@query
def binary_scores(spark, folder):
    """Class confidences and predicted class of every row by the binary tree."""
    return _scores(*_binary_tree(spark, folder))


@query
def binary_scores_staged(spark, folder):
    """The same in stages of a few nodes."""
    df, model = _binary_tree(spark, folder)
    return tidy(score.score_rows(score.score_table(df, model, KEY, stage_nodes=4), *KEY))


@query
def tree_rules(spark, folder):
    """One readable rule per leaf of the multi-way tree."""
    found = describe.tree_rules(_multi_tree(spark, folder)[1])
    return tidy(found.select("rule", imp.array_total(F.col("u")).alias("u"), imp.array_total(F.col("freq")).alias("freq")), u=3)


@query
def tree_stats(spark, folder):
    """Size of the multi-way tree."""
    return tidy(describe.tree_stats(_multi_tree(spark, folder)[1]))


@query
def tree_stats_binary(spark, folder):
    """Size of the binary tree."""
    return tidy(describe.tree_stats(_binary_tree(spark, folder)[1]))


# ---- evaluation ------------------------------------------------------------------------------


def _evaluated(spark, folder) -> DataFrame:
    """Confusion matrix of the multi-way tree."""
    df, model = _multi_tree(spark, folder)
    return evaluate.confusion_matrix(score.score_table(df, model, ["cls"]), CLASSES, "cls")


@query
def confusion_matrix(spark, folder):
    """Rows per class and predicted class."""
    return tidy(_evaluated(spark, folder))


@query
def accuracy_stats(spark, folder):
    """Accuracy, geometric mean of recalls and mean recall."""
    return tidy(evaluate.accuracy_stats(_evaluated(spark, folder)))


@query
def accuracy_report(spark, folder):
    """The same as lines of a report."""
    return tidy(reports.accuracy_lines(_evaluated(spark, folder)))


@query
def confusion_report(spark, folder):
    """The confusion matrix as one line per class."""
    return tidy(reports.confusion_grid(_evaluated(spark, folder), CLASSES))


@query
def error_rate(spark, folder):
    """Share of rows predicted wrongly."""
    df, model = _multi_tree(spark, folder)
    return tidy(evaluate.error_rate(score.score_table(df, model, ["cls"]), "cls"))


@query
def model_summary(spark, folder):
    """Sizes of the partitions and of the multi-way tree as lines of a report."""
    _, model = _multi_tree(spark, folder)
    return tidy(reports.model_summary(describe.cores_table(model.features, spark), model))


@query
def examples_round_trip(spark, folder):
    """Rows written as headerless lines with a header file, read back by it, and summed per class."""
    df = labelled(spark, folder)
    path = f"{shared_folder(spark)}/examples-{uuid.uuid4().hex}"
    columns = [*NUMERIC, *NOMINAL, CONSTANT, "cls"]
    df.select(*columns).write.csv(f"{path}/rows")
    listed = attributes(spark, df).orderBy("idx")
    bounds = F.concat(F.lit(" real["), F.col("lo").cast("string"), F.lit(","), F.col("hi").cast("string"), F.lit("]"))
    words = F.concat(F.lit("{"), F.array_join("values", ", "), F.lit("}"))
    line = F.concat(F.lit("@attribute "), "name", F.when(F.col("kind") == "numeric", bounds).otherwise(words))
    lines = listed.agg(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))).alias("all")).select(
        F.concat_ws("\n", F.lit("@relation items"), F.concat_ws("\n", "all.line"), F.lit("@outputs cls")).alias("value")
    )
    lines.write.text(f"{path}/header")
    declared = examples.read_attributes(spark, f"{path}/header")
    rows = examples.read_examples(spark, f"{path}/rows", declared)
    coded = encode.encode_examples(rows, declared)
    return tidy(coded.groupBy("cls").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in (*NUMERIC, *NOMINAL, CONSTANT)]
    ), 2)


@query
def rejected_lines(spark, folder):
    """Lines of line items, every fifth order with a quantity that is no number and every seventh one field short: what was read and what refused."""
    items = read_table(spark, folder, "lineitem")
    path = f"{shared_folder(spark)}/sifted-{uuid.uuid4().hex}"
    quantity = F.when(F.col("l_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
    price = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice").cast("string"))
    items.select(F.concat_ws(", ", quantity, price, "l_returnflag").alias("value")).write.text(f"{path}/rows")
    lines = ["@attribute quantity real[0, 100]", "@attribute price real[0, 1000000]", "@attribute flag {A, N, R}", "@outputs flag"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{path}/header")
    good, bad = examples.sift_examples(spark, f"{path}/rows", examples.read_attributes(spark, f"{path}/header"))
    read = good.select(F.concat(F.lit("read, flag "), "flag").alias("outcome"), F.col("quantity").alias("q"))
    outcomes = read.unionByName(bad.select(F.col("reason").alias("outcome"), F.lit(0.0).alias("q")))
    return tidy(outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("quantity")), 2)


def _study(spark, folder):
    df = labelled(spark, folder)
    return fit_and_evaluate(df, df, attributes(spark, df), max_depth=2, bins=100)


@query
def fit_and_evaluate_confusion(spark, folder):
    """Confusion matrix of the whole study: scaled columns, even sets, tree of depth two."""
    return tidy(_study(spark, folder).confusion)


@query
def fit_and_evaluate_nodes(spark, folder):
    """The tree of that study."""
    return _node_rows(_study(spark, folder).model)
