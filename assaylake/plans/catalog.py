"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver's tables (or tables Spark derives from them) in
full. Doubles are rounded to 6 places so the DuckDB oracle in
:mod:`assaylake.plans.oracle` can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake import sources
from assaylake.functions import numeric as num
from assaylake.functions import text as txt
from assaylake.operators import answers, metrics, profile, prompts, retrieval, splits, udf
from assaylake.operators import consensus as cons
from assaylake.operators import fingerprint as fpr
from assaylake.operators import bucketed, consensus_state, features, keys, prefix_join
from assaylake.operators import similarity as sim
from assaylake.plans.proxies import (
    LINEITEM_ENDPOINTS, LINEITEM_KEY, LINEITEM_ORDER, LINEITEM_VALUES,
    measurements, r6, table,
)
from assaylake.schema import (
    ENDPOINTS, FP_BITS, FP_RADIUS, HIST_BINS, JITTER_SD, N_FOLDS, N_REPLICAS, PROPERTIES,
    RANDOM_SEED, TOPK_EXTERNAL, TOPK_TARGET, Endpoint,
)
from assaylake.session import cut_lineage
from assaylake.streaming import parse_answer_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def _round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[r6(keys.qcol(f.name)).alias(f.name) if f.dataType.typeName() == "double"
                       else keys.qcol(f.name) for f in df.schema.fields])


# --- step 1: consensus slice ------------------------------------------------

@query("consensus")
def q_consensus(spark, sf_dir):
    m = measurements(spark, sf_dir)
    out = cons.consensus(m, LINEITEM_KEY, LINEITEM_ENDPOINTS, LINEITEM_ORDER,
                         keep=["l_orderkey", "l_linenumber", "l_returnflag"])
    return _round_doubles(out)


CONSENSUS_KEEP = ["l_orderkey", "l_linenumber", "l_returnflag"]


def batched_state(spark, sf_dir, n_batches=3):
    """States of the measurements of ``n_batches`` sets of orders; the second arrives twice."""
    m = measurements(spark, sf_dir)
    states = consensus_state.StateTable(spark, sources.scratch_path(spark, "consensus_state"), LINEITEM_KEY,
                                        LINEITEM_ENDPOINTS, LINEITEM_ORDER, CONSENSUS_KEEP)
    for b in [*range(n_batches), 1]:
        states.add(m.where(F.col("l_orderkey") % n_batches == b), b)
    return states


@query("incremental_consensus")
def q_incremental_consensus(spark, sf_dir):
    """The consensus of measurements that came in batches, from their merged states."""
    return _round_doubles(batched_state(spark, sf_dir).consensus())


@query("incremental_flags")
def q_incremental_flags(spark, sf_dir):
    states = batched_state(spark, sf_dir)
    states.compact()
    return states.flags()


@query("disagreement_flags")
def q_disagreement_flags(spark, sf_dir):
    m = measurements(spark, sf_dir)
    return cons.disagreement_flags(m, LINEITEM_KEY, LINEITEM_ENDPOINTS)


@query("endpoint_std")
def q_endpoint_std(spark, sf_dir):
    return _round_doubles(cons.endpoint_std(measurements(spark, sf_dir), LINEITEM_ENDPOINTS))


@query("first_per_key")
def q_first_per_key(spark, sf_dir):
    m = measurements(spark, sf_dir)
    return keys.first_per_key(m, LINEITEM_KEY, LINEITEM_ORDER,
                              ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
                               "l_quantity"])


@query("log_transform")
def q_log_transform(spark, sf_dir):
    m = measurements(spark, sf_dir)
    return _round_doubles(m.select(
        *LINEITEM_ORDER,
        *[num.log10p1(F.col(c)).alias(f"log_{c}") for c in LINEITEM_VALUES]))


# --- step 2: functions, keys, splits, unions --------------------------------


MEASUREMENT_SCHEMA = (
    "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, "
    "l_returnflag STRING, l_linestatus STRING, l_quantity DOUBLE, l_extendedprice DOUBLE, "
    "l_discount DOUBLE, l_tax DOUBLE")

# Key normalisation rules for document texts: fold case, one blank between
# words, no outer blanks; reject keys under 10 characters or holding a run of
# six or more digits (numbers that identify people or accounts).
WHITESPACE_RUN = r"[\t\n\x0B\f\r ]+"
TEXT_KEY_RULES = (F.lower, lambda c: F.regexp_replace(c, WHITESPACE_RUN, " "), F.trim)
TEXT_KEY_REJECT = (lambda c: F.length(c) < 10, lambda c: c.rlike("[0-9]{6,}"))


def documents(spark, sf_dir):
    """documents (doc_id, text)."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def text_keys(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return keys.normalise_keys(docs, "text", TEXT_KEY_RULES, TEXT_KEY_REJECT, out="key")


def _digest(c, name):
    return [F.md5(c).alias(f"{name}_md5"), F.length(c).cast("bigint").alias(f"{name}_len")]


@query("scan_roundtrip")
def q_scan_roundtrip(spark, sf_dir):
    path = sources.scratch_path(spark, "scan_roundtrip")
    sources.write_assay(measurements(spark, sf_dir), path)
    return sources.read_assay(spark, path, MEASUREMENT_SCHEMA, fmt="tsv")


@query("log_floor")
def q_log_floor(spark, sf_dir):
    m = measurements(spark, sf_dir)
    return _round_doubles(m.select(
        *LINEITEM_ORDER,
        *[num.log10_floor(F.col(e.name), e.floor).alias(f"lf_{e.name}")
          for e in LINEITEM_ENDPOINTS]))


@query("log_edges")
def q_log_edges(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return _round_doubles(c.select(
        "c_custkey", num.log10_ieee(F.col("c_acctbal")).alias("log_acctbal"),
        num.log10p1(F.col("c_acctbal")).alias("log1p_acctbal")))


@query("back_transform")
def q_back_transform(spark, sf_dir):
    m = measurements(spark, sf_dir)
    preds = m.select(*LINEITEM_ORDER, *[num.log10p1(F.col(e.name)).alias(f"pred_{e.log_name}")
                                        for e in LINEITEM_ENDPOINTS])
    return _round_doubles(metrics.extract_predictions(preds, LINEITEM_ENDPOINTS, LINEITEM_ORDER[:4]))


@query("format_two_decimals")
def q_format_two_decimals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LINEITEM_ORDER,
                     num.fmt2(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_txt"),
                     num.fmt2(F.col("l_quantity") / 7).alias("qty7_txt"),
                     num.trunc_int(F.col("l_extendedprice") / 7).alias("price7_int"))


@query("jitter")
def q_jitter(spark, sf_dir):
    m = measurements(spark, sf_dir)
    key = F.concat_ws(":", F.lit("42"), *[F.col(c).cast("string") for c in
                                          ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return _round_doubles(m.select(*LINEITEM_ORDER, num.hashed_gauss(key, 0.02).alias("jitter")))


@query("extension_suffix")
def q_extension_suffix(spark, sf_dir):
    d = documents(spark, sf_dir)
    s = txt.extension_suffix(F.col("text"))
    return d.select("doc_id", *_digest(s, "suffix"))


@query("normalise_keys")
def q_normalise_keys(spark, sf_dir):
    return text_keys(spark, sf_dir).select("doc_id", *_digest(F.col("key"), "key"))


# A second key: the largest sentence only, the same clean-up, and the check made on what is left.
SECOND_KEY_RULES = (txt.largest_component, *TEXT_KEY_RULES)


@query("second_keys")
def q_second_keys(spark, sf_dir):
    """First key, second key from it, and the second rejected again where it has become too short."""
    first = text_keys(spark, sf_dir).select("doc_id", "key")
    both = keys.normalise_keys(first, "key", SECOND_KEY_RULES, TEXT_KEY_REJECT, out="second")
    return both.select("doc_id", *_digest(F.col("key"), "key"), *_digest(F.col("second"), "second"))


@query("reject_count")
def q_reject_count(spark, sf_dir):
    return keys.reject_count(text_keys(spark, sf_dir), "key")


@query("largest_component")
def q_largest_component(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", *_digest(txt.largest_component(F.col("text")), "component"))


@query("duplicate_members")
def q_duplicate_members(spark, sf_dir):
    m = measurements(spark, sf_dir).select(*LINEITEM_ORDER)
    return keys.duplicate_members(m, LINEITEM_KEY)


@query("duplicate_extras")
def q_duplicate_extras(spark, sf_dir):
    m = measurements(spark, sf_dir).select(*LINEITEM_ORDER)
    return keys.duplicate_extras(m, LINEITEM_KEY, LINEITEM_ORDER)


@query("keyed_members")
def q_keyed_members(spark, sf_dir):
    """Group size and repeat flag of every row, from rows that lie bucketed by key."""
    table_ = bucketed.KeyedTable(measurements(spark, sf_dir).select(*LINEITEM_ORDER), LINEITEM_KEY)
    return table_.with_first(LINEITEM_ORDER, "is_extra", "group_size").select(
        *LINEITEM_ORDER, "is_extra", "group_size")


@query("duplicate_key_count")
def q_duplicate_key_count(spark, sf_dir):
    return keys.duplicate_key_count(measurements(spark, sf_dir), LINEITEM_KEY)


@query("group_range")
def q_group_range(spark, sf_dir):
    m = measurements(spark, sf_dir)
    return _round_doubles(keys.group_range(m, LINEITEM_KEY, LINEITEM_VALUES, LINEITEM_ORDER,
                                           members="extras"))


@query("group_number")
def q_group_number(spark, sf_dir):
    m = measurements(spark, sf_dir).select(*LINEITEM_ORDER)
    return keys.group_number(m, LINEITEM_KEY, "group_no")


def _clean_keys(spark, sf_dir):
    m = measurements(spark, sf_dir)
    return cons.consensus(m, LINEITEM_KEY, LINEITEM_ENDPOINTS, LINEITEM_ORDER, log=False)


@query("kfold")
def q_kfold(spark, sf_dir):
    folds = splits.kfold(_clean_keys(spark, sf_dir).select(*LINEITEM_KEY), LINEITEM_KEY, N_FOLDS, RANDOM_SEED)
    return folds.select(*LINEITEM_KEY, "fold", "split")


@query("kfold_sizes")
def q_kfold_sizes(spark, sf_dir):
    folds = splits.kfold(_clean_keys(spark, sf_dir).select(*LINEITEM_KEY), LINEITEM_KEY, N_FOLDS, RANDOM_SEED)
    return splits.kfold_sizes(folds)


def labelled_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "inner")


def unlabelled_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti")


def external_items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


@query("tagged_union")
def q_tagged_union(spark, sf_dir):
    u = sources.union_assays(labelled_documents(spark, sf_dir),
                             unlabelled_documents(spark, sf_dir),
                             external_items(spark, sf_dir),
                             tags=["train", "test", "external"])
    return u.select("split", "doc_id", "item_id", "quality", "toxic", *_digest(F.col("text"), "text"))


def reference_set(spark, sf_dir):
    """Training documents then external items, with positions ``ref_id``."""
    u = sources.union_assays(labelled_documents(spark, sf_dir), external_items(spark, sf_dir),
                             tags=["train", "external"])
    u = u.withColumn("__origin", F.when(F.col("split") == "train", 0).otherwise(1))
    u = u.withColumn("__id", F.coalesce("doc_id", "item_id"))
    return keys.with_row_id(u, ["__origin", "__id"], "ref_id").drop("__origin", "__id")


@query("reference_union")
def q_reference_union(spark, sf_dir):
    r = reference_set(spark, sf_dir)
    return r.select("ref_id", "split", "doc_id", "item_id", "quality", "toxic",
                    *_digest(F.col("text"), "text"))


@query("flatten_records")
def q_flatten_records(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return sources.flatten_records(ev, "event_id", "props", ["k"])


@query("flatten_ids")
def q_flatten_ids(spark, sf_dir):
    """Records without labels: the id column alone."""
    return sources.flatten_records(table(spark, sf_dir, "events"), "event_id", "props", [], id_alias="record_id")


@query("accepted_keys")
def q_accepted_keys(spark, sf_dir):
    """The documents whose key was not rejected."""
    return keys.drop_rejected(text_keys(spark, sf_dir), "key").select("doc_id", *_digest(F.col("key"), "key"))


@query("positional_profile")
def q_positional_profile(spark, sf_dir):
    """Null share of the columns from the third on, but for one."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINEITEM_VALUES, "l_linestatus") \
        .withColumns({v: F.when(F.col(v) > 10, F.col(v)) for v in LINEITEM_VALUES})
    return _round_doubles(profile.null_profile(li, keys.endpoint_columns(li, exclude=["l_linestatus"], start=2)))


@query("cached_table")
def q_cached_table(spark, sf_dir):
    """Measurements landed once as TSV; the second request finds the finished table."""
    base = sources.scratch_path(spark, "cached_table")

    def landed(build):
        return sources.cached(spark, base, "measurements", build, {"columns": MEASUREMENT_SCHEMA},
                              [f"{sf_dir}/lineitem.parquet"], fmt="tsv")

    def never():
        raise RuntimeError("the table was not found again")

    landed(lambda: measurements(spark, sf_dir))
    return landed(never)


@query("named_output")
def q_named_output(spark, sf_dir):
    """Records as JSON lines in a place named by the run's settings, read back with that name."""
    base = sources.scratch_path(spark, "named_output")
    path = sources.prompt_path(base, TOPK_TARGET, TOPK_EXTERNAL)
    items = external_items(spark, sf_dir)
    sources.write_chat_jsonl(items.select(F.struct("item_id", "text").alias("record")), path)
    back = spark.read.schema("item_id long, text string").json(base + "/*")
    run = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)[.]jsonl/", 1)
    return back.select("item_id", *_digest(F.col("text"), "text"), run.alias("run"))


# --- step 3: profiles ---------------------------------------------------------


DOC_PROFILE_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
PART_COLS = ["p_size", "p_retailprice"]


def documents_with_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("null_profile")
def q_null_profile(spark, sf_dir):
    return _round_doubles(profile.null_profile(documents_with_labels(spark, sf_dir),
                                               DOC_PROFILE_COLS))


@query("all_null_pct")
def q_all_null_pct(spark, sf_dir):
    return _round_doubles(profile.all_null_pct(documents_with_labels(spark, sf_dir),
                                               ["quality", "toxic"]))


@query("describe_columns")
def q_describe_columns(spark, sf_dir):
    return _round_doubles(profile.describe_columns(table(spark, sf_dir, "part"), PART_COLS))


@query("histogram_auto")
def q_histogram_auto(spark, sf_dir):
    return _round_doubles(profile.histogram(measurements(spark, sf_dir), LINEITEM_VALUES, "auto"))


HIST_RANGE = (0.02, 40.0)


@query("histogram_range")
def q_histogram_range(spark, sf_dir):
    """Automatic bins on an axis that all columns share."""
    return _round_doubles(profile.histogram(measurements(spark, sf_dir), LINEITEM_VALUES, "auto", HIST_RANGE))


@query("group_range_histogram")
def q_group_range_histogram(spark, sf_dir):
    """Histogram of the ranges inside groups of repeated measurements."""
    m = measurements(spark, sf_dir)
    ranges = keys.group_range(m, LINEITEM_KEY, LINEITEM_VALUES, LINEITEM_ORDER, members="extras")
    return _round_doubles(profile.histogram(ranges, [f"range_{v}" for v in LINEITEM_VALUES], HIST_BINS))


@query("histogram_fixed")
def q_histogram_fixed(spark, sf_dir):
    return _round_doubles(profile.histogram(measurements(spark, sf_dir), LINEITEM_VALUES, 30))


@query("corr_matrix")
def q_corr_matrix(spark, sf_dir):
    return _round_doubles(profile.corr_matrix(measurements(spark, sf_dir), LINEITEM_VALUES))


@query("pair_statistics")
def q_pair_statistics(spark, sf_dir):
    """Correlation and line of every ordered pair of columns, from one scan."""
    return _round_doubles(profile.pair_statistics(measurements(spark, sf_dir), LINEITEM_VALUES))


@query("linear_fit_matrix")
def q_linear_fit_matrix(spark, sf_dir):
    return _round_doubles(profile.linear_fit_matrix(measurements(spark, sf_dir), LINEITEM_VALUES))


@query("smallest_values")
def q_smallest_values(spark, sf_dir):
    return profile.smallest_values(measurements(spark, sf_dir), LINEITEM_VALUES, 10)


# --- step 4: answers and metrics --------------------------------------------


# events in the role of model answers: each event of a user is one candidate
# answer to that user's query.
EVENT_PROPERTY = {"click": "LogHLM", "error": "LogMLM", "purchase": "LogD",
                  "signup": "LogKSOL", "view": "LogMDR1-MDCKII"}


def candidates(spark, sf_dir):
    return event_candidates(table(spark, sf_dir, "events"))


def event_candidates(ev):
    """``(query_id, candidate_no, text)`` answer texts built from event rows."""
    k = F.get_json_object("props", "$.k")
    prop = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(p)) for t, p in EVENT_PROPERTY.items()])
    v = num.fmt2(F.col("value") / 100)
    kv = num.fmt2(k.cast("int") / 10)
    text = (F.when((F.col("event_type") == "error") & (F.col("value") > 300), F.lit("no answer"))
            .when(F.col("event_type") == "purchase",
                  F.concat(F.lit("LogD="), v, F.lit(", LogD="), kv, F.lit(", k="), k))
            .when(F.col("event_type") == "view",
                  F.concat(F.lit("LogMDR1-MDCKII="), v, F.lit("; Other-Name="), kv))
            .otherwise(F.concat(prop, F.lit("="), v, F.lit(", k="), k)))
    return ev.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("candidate_no"),
                     text.alias("text"))


@query("parse_answers")
def q_parse_answers(spark, sf_dir):
    return answers.parse_answers(candidates(spark, sf_dir))


@query("average_answers")
def q_average_answers(spark, sf_dir):
    return _round_doubles(answers.average_answers(candidates(spark, sf_dir), PROPERTIES))


@query("attach_predictions")
def q_attach_predictions(spark, sf_dir):
    preds = answers.prefix_columns(answers.average_answers(candidates(spark, sf_dir), PROPERTIES),
                                   PROPERTIES)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id")).distinct()
    out = answers.attach_predictions(rows, preds, "query_id")
    return _round_doubles(answers.back_transform_predictions(out, ENDPOINTS))


# lineitem as predictions vs truth, endpoint = return flag; 'N' plays the
# endpoint that is already on a log scale.
EVAL_ENDPOINTS = (Endpoint("A"), Endpoint("N", log_encoded=False), Endpoint("R"))


def evaluation_input(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LINEITEM_ORDER, F.col("l_returnflag").alias("endpoint"),
                     F.when(F.col("l_discount") != 0, F.col("l_extendedprice")).alias("ref"),
                     (F.col("l_quantity") * 1500).alias("pred"))


@query("evaluate")
def q_evaluate(spark, sf_dir):
    res = metrics.evaluate(evaluation_input(spark, sf_dir), EVAL_ENDPOINTS, macro=False)
    return _round_doubles(res)


@query("evaluate_nan_truths")
def q_evaluate_nan_truths(spark, sf_dir):
    """A truth that is NaN is a missing one."""
    pairs = evaluation_input(spark, sf_dir).withColumn("ref", F.coalesce("ref", F.lit(float("nan"))))
    return _round_doubles(metrics.evaluate(pairs, EVAL_ENDPOINTS, macro=False))


@query("evaluate_macro")
def q_evaluate_macro(spark, sf_dir):
    res = metrics.evaluate(evaluation_input(spark, sf_dir), EVAL_ENDPOINTS, macro=True)
    return _round_doubles(res.where(F.col("endpoint") == "aggregated"))


@query("score_end_to_end")
def q_score_end_to_end(spark, sf_dir):
    """Predictions to linear scale, references by endpoint, aligned and scored."""
    m = keys.with_row_id(measurements(spark, sf_dir), LINEITEM_ORDER, "row_id")
    ids = ["row_id"]
    preds = m.select(*ids, *[num.log10p1(F.coalesce(F.col(e.name), F.lit(0.0)) * 1.1 + 0.5)
                             .alias(f"pred_{e.log_name}") for e in LINEITEM_ENDPOINTS])
    pairs = metrics.align(metrics.extract_predictions(preds, LINEITEM_ENDPOINTS, ids),
                          metrics.extract_references(m, LINEITEM_ENDPOINTS, ids), ids, LINEITEM_ENDPOINTS)
    return _round_doubles(metrics.evaluate(pairs, LINEITEM_ENDPOINTS))


# --- step 5: fingerprints and similarity -------------------------------------


FP_WORDS = FP_BITS // 64

# Substructure-key dictionary for texts, built from rules: a doubled letter
# (either case), each digit, punctuation marks, and layout features.
TEXT_PATTERNS = (
    [f"[{c.upper()}{c}]{{2}}" for c in "abcdefghijklmnopqrstuvwxyz"]
    + [str(d) for d in range(10)]
    + [",", ";", ":", "!", r"\?", r"\(", '"', "'", "-", r"\|"]
    + [r"\n\n", "[A-Z]{3}", "[0-9]{4}", "https?://", "@", r"[^\x00-\x7F]", "  ", r"\.\.\."]
)
PATTERN_WORDS = (len(TEXT_PATTERNS) + 63) // 64

# Feature profile of a text: counts shown as integers, mean word length with
# two decimals.
TEXT_FEATURES = (
    ("chars", lambda t, n: F.length(t), "int"),
    ("words", lambda t, n: n, "int"),
    ("lines", lambda t, n: F.size(F.split(t, "\n")), "int"),
    ("digits", lambda t, n: F.length(F.regexp_replace(t, "[^0-9]", "")), "int"),
    ("upper", lambda t, n: F.length(F.regexp_replace(t, "[^A-Z]", "")), "int"),
    ("avgword", lambda t, n: F.try_divide(F.length(t), n), "2f"),
)


FEATURE_CODE = 1  # to be raised whenever the code of a feature changes what it gives


def count_words(text):
    return F.size(txt.word_tokens(text))


def text_profile(text_col="text"):
    return fpr.profile_text(text_col, TEXT_FEATURES, shared=count_words)


def _hashed(texts):
    return fpr.hashed_fingerprint(texts, features.KEY, "text", FP_RADIUS, FP_BITS)


def _patterned(texts):
    return fpr.pattern_fingerprint(texts, features.KEY, "text", TEXT_PATTERNS)


def document_fps(spark, sf_dir):
    """Fingerprints of all documents, from the table of texts met before."""
    kept = features.FeatureTable(spark, None, "hashed",
                                 {"code": FEATURE_CODE, "radius": FP_RADIUS, "bits": FP_BITS, "hash": "md5"}, _hashed)
    return kept.of(documents(spark, sf_dir), "doc_id", "text")


def _labelled_ids(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id")


def split_fps(spark, sf_dir):
    """(train, test) fingerprints from one written table.

    Labelled (measured) documents are the training set, the others the test
    set; every text is tokenised once.
    """
    fps = document_fps(spark, sf_dir)
    ids = _labelled_ids(spark, sf_dir)
    return fps.join(ids, "doc_id", "left_semi"), fps.join(ids, "doc_id", "left_anti")


def train_fps(spark, sf_dir):
    return split_fps(spark, sf_dir)[0]


def test_fps(spark, sf_dir):
    return split_fps(spark, sf_dir)[1]


@query("hashed_fingerprint")
def q_hashed_fingerprint(spark, sf_dir):
    f = features.by_content(documents(spark, sf_dir), "doc_id", "text", _hashed)
    return f.select("doc_id", *[F.col("fp")[j].alias(f"w{j:02d}") for j in range(FP_WORDS)],
                    "n_bits_set")


@query("pattern_fingerprint")
def q_pattern_fingerprint(spark, sf_dir):
    f = features.by_content(documents(spark, sf_dir), "doc_id", "text", _patterned)
    return f.select("doc_id", *[F.col("fp")[j].alias(f"w{j:02d}") for j in range(PATTERN_WORDS)],
                    "n_bits_set")


@query("profile_text")
def q_profile_text(spark, sf_dir):
    return features.by_content(documents(spark, sf_dir), "doc_id", "text",
                               lambda texts: texts.select(features.KEY, text_profile()))


@query("tanimoto_pairs")
def q_tanimoto_pairs(spark, sf_dir):
    train, test = split_fps(spark, sf_dir)
    dist = sim.similarity_distribution(train, test, FP_WORDS, "doc_id")
    return _round_doubles(sim.similarity_histogram(dist, HIST_BINS))


def _train_test_nearest(spark, sf_dir, side):
    train, test = split_fps(spark, sf_dir)
    return sim.nearest(train, test, FP_WORDS, "doc_id", sides=side)


@query("nearest_left")
def q_nearest_left(spark, sf_dir):
    n = _train_test_nearest(spark, sf_dir, "left")
    return _round_doubles(n.select("doc_id", "best_sim"))


@query("nearest_right")
def q_nearest_right(spark, sf_dir):
    n = _train_test_nearest(spark, sf_dir, "right")
    return _round_doubles(n.select("doc_id", "best_sim"))


@query("nearest_other")
def q_nearest_other(spark, sf_dir):
    return _round_doubles(sim.nearest(train_fps(spark, sf_dir), None, FP_WORDS, "doc_id"))


@query("nearest_histogram")
def q_nearest_histogram(spark, sf_dir):
    """Histogram of the closest-match similarities of the training documents."""
    best = sim.nearest(train_fps(spark, sf_dir), None, FP_WORDS, "doc_id")
    return _round_doubles(profile.histogram(best, ["best_sim"], HIST_BINS))


@query("threshold_pairs")
def q_threshold_pairs(spark, sf_dir):
    """Training documents whose fingerprints reach a similarity of 0.5."""
    return _round_doubles(sim.tanimoto_join(train_fps(spark, sf_dir), None, FP_WORDS, 0.5, "doc_id"))


@query("threshold_links")
def q_threshold_links(spark, sf_dir):
    """Class, copies and links of every training document, without a list of pairs."""
    return prefix_join.tanimoto_links(train_fps(spark, sf_dir), FP_WORDS, 0.5, "doc_id")[0]


@query("threshold_class_pairs")
def q_threshold_class_pairs(spark, sf_dir):
    """Links between different fingerprints, each named by its smallest document."""
    return _round_doubles(prefix_join.tanimoto_links(train_fps(spark, sf_dir), FP_WORDS, 0.5, "doc_id")[1])


@query("pair_histogram")
def q_pair_histogram(spark, sf_dir):
    dist = sim.similarity_distribution(train_fps(spark, sf_dir), None, FP_WORDS, "doc_id",
                                       exclude="lower")
    return _round_doubles(sim.similarity_histogram(dist, HIST_BINS))


@query("identical_pairs")
def q_identical_pairs(spark, sf_dir):
    return sim.identical_groups(train_fps(spark, sf_dir), "doc_id")


@query("identical_pairs_head")
def q_identical_pairs_head(spark, sf_dir):
    groups = sim.identical_groups(train_fps(spark, sf_dir), "doc_id")
    return sim.identical_pairs_head(groups, "doc_id", 10)


@query("identical_pair_rows")
def q_identical_pair_rows(spark, sf_dir):
    """The first identical pairs with the rows of both members."""
    pairs = q_identical_pairs_head(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    return sim.pair_rows(pairs, docs, "doc_id").select(
        "i", "j", "i_lang", "j_lang", "i_n_chars", "j_n_chars", *_digest(F.col("i_text"), "i_text"),
        *_digest(F.col("j_text"), "j_text"))


@query("near_identical_count")
def q_near_identical_count(spark, sf_dir):
    return sim.identical_pair_counts(sim.identical_groups(train_fps(spark, sf_dir), "doc_id"))


EMBEDDING_WORDS = 1  # words for the sign bits of one embedding


def embedding_fps(spark, sf_dir):
    """Sign bits of the embeddings, 64 to a word."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return fpr.sign_fingerprint(e, "vec_id", "embedding", EMBEDDING_WORDS)


@query("embedding_nearest")
def q_embedding_nearest(spark, sf_dir):
    return _round_doubles(sim.nearest(embedding_fps(spark, sf_dir), None, EMBEDDING_WORDS, "vec_id"))


@query("query_reference_sim")
def q_query_reference_sim(spark, sf_dir):
    docs = text_features(documents(spark, sf_dir), "doc_id").withColumnRenamed("doc_id", "id")
    refs = text_features(external_items(spark, sf_dir), "item_id").withColumnRenamed("item_id", "id")
    top = sim.topk_matches(docs, refs, PATTERN_WORDS, [3], "id")
    return _round_doubles(top.select(F.col("query_id").alias("doc_id"), "rank",
                                     F.col("ref_id").alias("item_id"), "sim"))


# --- step 6: retrieval, records, JSON lines -----------------------------------


# Properties of the proxy: three measured on training documents, two on the
# external items; k per property as in the workflow (target 5, external 3).
INTERNAL_PROPS = ["quality", "toxic", "log_chars"]
EXTERNAL_PROPS = ["ext_log_len", "ext_log_words"]
RETRIEVAL_PROPS = ([(p, TOPK_TARGET) for p in INTERNAL_PROPS]
                   + [(p, TOPK_EXTERNAL) for p in EXTERNAL_PROPS])
KEY_LABEL = "KEY"


def _featurised(texts):
    """Pattern fingerprint, canonical key, profile and size measures of each text."""
    feats = texts.select(features.KEY, "text", F.md5("text").alias("key"), text_profile(),
                         F.length("text").alias("n_chars"), count_words(F.col("text")).alias("n_words"))
    return fpr.pattern_fingerprint(feats, features.KEY, "text", TEXT_PATTERNS,
                                   keep=["key", "profile", "n_chars", "n_words"])


def text_features(df, id_col):
    """Features of each row's text, from the table of texts met before."""
    settings = {"code": FEATURE_CODE, "patterns": TEXT_PATTERNS, "profile": [(n, k) for n, _, k in TEXT_FEATURES]}
    kept = features.FeatureTable(df.sparkSession, None, "text", settings, _featurised)
    return kept.of(df, id_col, "text")


def _retrieval_tables(spark, sf_dir):
    """(queries, refs) built from one pass of text features over the documents."""
    doc_feats = text_features(documents(spark, sf_dir), "doc_id")
    labels = table(spark, sf_dir, "labels")
    q = doc_feats.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("query_id"), "fp", "n_bits_set", "key", "profile",
        F.col("quality").isNull().alias("is_test"),
        F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("double").alias("toxic"),
        F.when(F.col("quality").isNotNull(), num.log10p1(F.col("n_chars"))).alias("log_chars"))
    train = doc_feats.join(labels, "doc_id", "inner")
    ext = text_features(external_items(spark, sf_dir), "item_id")
    u = sources.union_assays(train, ext, tags=["train", "external"])
    u = u.withColumn("__origin", F.when(F.col("split") == "train", 0).otherwise(1)) \
         .withColumn("__id", F.coalesce("doc_id", "item_id"))
    u = keys.with_row_id(u, ["__origin", "__id"], "ref_id")
    is_train, is_ext = F.col("split") == "train", F.col("split") == "external"
    refs = u.select(
        "ref_id", "fp", "n_bits_set", "key", "profile",
        F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("double").alias("toxic"),
        F.when(is_train, num.log10p1(F.col("n_chars"))).alias("log_chars"),
        F.when(is_ext, num.log10p1(F.col("n_chars"))).alias("ext_log_len"),
        F.when(is_ext, num.log10p1(F.col("n_words"))).alias("ext_log_words"))
    return q, refs


def retrieval_refs(spark, sf_dir):
    """Reference rows: fingerprint, canonical key, profile and property values."""
    return _retrieval_tables(spark, sf_dir)[1]


def retrieval_queries(spark, sf_dir):
    """Every document is a query; unlabelled ones are test queries."""
    return _retrieval_tables(spark, sf_dir)[0]


class _Retrieval:
    """Reference and query tables of one query run, each materialised once."""

    def __init__(self, spark, sf_dir):
        # Both tables start at materialised files (text features, the
        # positioned reference rows); re-reading them is cheap.
        self.queries, self.refs = _retrieval_tables(spark, sf_dir)

    def neighbours(self, queries=None):
        q = self.queries if queries is None else queries
        return retrieval.topk_neighbours(q, self.refs, RETRIEVAL_PROPS, PATTERN_WORDS)

    def merged(self, nb):
        # Written first: the comparison is not run again by whatever reads the result twice.
        return retrieval.merge_neighbours(cut_lineage(nb), self.refs.select("ref_id", "key", "profile"))


def _neighbours(spark, sf_dir):
    return _Retrieval(spark, sf_dir).neighbours()


@query("topk_neighbours")
def q_topk_neighbours(spark, sf_dir):
    return _round_doubles(_neighbours(spark, sf_dir))


@query("merge_neighbours")
def q_merge_neighbours(spark, sf_dir):
    r = _Retrieval(spark, sf_dir)
    m = r.merged(r.neighbours())
    return _round_doubles(m.select("query_id", "key", "pos_prop", "pos_rank", "sim", "props_text"))


def _train_queries(spark, sf_dir):
    """Training queries with their own property values (no text features needed)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n_chars"))
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "inner").select(
        F.col("doc_id").alias("query_id"),
        F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("double").alias("toxic"),
        num.log10p1(F.col("n_chars")).alias("log_chars"))


@query("training_targets")
def q_training_targets(spark, sf_dir):
    t = retrieval.query_targets(_train_queries(spark, sf_dir), INTERNAL_PROPS)
    return _round_doubles(t.select("query_id", "property", "value"))


@query("replicated_targets")
def q_replicated_targets(spark, sf_dir):
    t = retrieval.query_targets(_train_queries(spark, sf_dir), INTERNAL_PROPS,
                                replicas=N_REPLICAS, seed=RANDOM_SEED, jitter_sd=JITTER_SD)
    return _round_doubles(t.select("replica", "query_id", "property", "value"))


def train_prompts(spark, sf_dir):
    r = _Retrieval(spark, sf_dir)
    train_q = r.queries.where(~F.col("is_test"))
    nb = r.neighbours(train_q)
    targets = retrieval.query_targets(train_q, INTERNAL_PROPS)
    return prompts.render_prompts(train_q, r.merged(nb), targets, INTERNAL_PROPS, KEY_LABEL, N_REPLICAS,
                                  RANDOM_SEED, JITTER_SD)


@query("render_prompts")
def q_render_prompts(spark, sf_dir):
    return train_prompts(spark, sf_dir)


@query("test_prompts")
def q_test_prompts(spark, sf_dir):
    r = _Retrieval(spark, sf_dir)
    test_q = r.queries.where(F.col("is_test"))
    out = prompts.render_prompts(test_q, r.merged(r.neighbours(test_q)), None, INTERNAL_PROPS,
                                 KEY_LABEL)
    return out.select("query_id", "context", "question")


CHAT_SCHEMA = ("systemInstruction struct<parts: array<struct<text: string>>>, "
               "contents array<struct<role: string, parts: array<struct<text: string>>>>")


@query("chat_jsonl")
def q_chat_jsonl(spark, sf_dir):
    path = sources.scratch_path(spark, "chat_jsonl")
    sources.write_chat_jsonl(prompts.chat_records(train_prompts(spark, sf_dir)), path)
    back = spark.read.schema(CHAT_SCHEMA).json(path)
    return back.select(
        F.col("contents")[0]["parts"][0]["text"].alias("context"),
        F.col("contents")[0]["parts"][1]["text"].alias("question"),
        F.col("contents")[1]["parts"][0]["text"].alias("answer"),
        F.size("contents").alias("n_turns"),
        F.col("systemInstruction").isNull().alias("no_system"))


# --- hooks and streaming ---------------------------------------------------------


def _path_length(key, batches):
    """Sum of the steps between neighbouring quantities of a group, batch after batch."""
    import pandas as pd
    n, total, last = 0, 0.0, None
    for pdf in batches:
        q = pdf["l_quantity"].to_numpy(float)
        total += abs(q[1:] - q[:-1]).sum() + (abs(q[0] - last) if last is not None else 0.0)
        n, last = n + len(q), q[-1]
    yield pd.DataFrame({"l_returnflag": [key[0]], "n": [n], "path": [total]})


@query("group_stream_hook")
def q_group_stream_hook(spark, sf_dir):
    """A user's ordered pass over each group; a group here is a large share of all rows."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    return _round_doubles(udf.map_groups(li, "l_returnflag", _path_length, "l_returnflag string, n long, path double",
                                         order=["l_orderkey", "l_linenumber", "l_quantity"]))


def _span_part(key, rows):
    return {"n": len(rows), "low": float(rows["l_extendedprice"].min()), "high": float(rows["l_extendedprice"].max())}


def _span_merge(a, b):
    return {"n": a["n"] + b["n"], "low": min(a["low"], b["low"]), "high": max(a["high"], b["high"])}


def _span(key, s):
    return {"n": s["n"], "span": s["high"] - s["low"]}


@query("group_reduce_hook")
def q_group_reduce_hook(spark, sf_dir):
    """A user's group-to-row function put together from parts made before the shuffle."""
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", "l_extendedprice")
    return _round_doubles(udf.reduce_groups(
        li, ["l_linestatus", "l_returnflag"], _span_part, _span_merge, "n long, low double, high double", _span,
        "n long, span double"))


def _count_vowels(text):
    return text.str.count("[aeiou]").astype("int64")


@query("udf_batch_hook")
def q_udf_batch_hook(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return udf.with_column_batch(d, "n_vowels", _count_vowels, "text",
                                 return_type="bigint").select("doc_id", "n_vowels")


def _line_stats(batch):
    import pandas as pd
    return pd.DataFrame({"doc_id": batch["doc_id"],
                         "n_lines": batch["text"].str.count("\n").astype("int64") + 1})


@query("map_batches_hook")
def q_map_batches_hook(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return udf.map_batches(d, _line_stats, "doc_id bigint, n_lines bigint")


EVENTS_SCHEMA = ("event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, "
                 "value DOUBLE, props STRING")


@query("stream_parse_answers")
def q_stream_parse_answers(spark, sf_dir):
    base = sources.scratch_path(spark, "answer_stream")

    parse_answer_stream(spark, sf_dir, EVENTS_SCHEMA, f"{base}/out", f"{base}/checkpoint",
                        event_candidates, file_glob="events.parquet")
    return spark.read.parquet(f"{base}/out")


# --- reports ------------------------------------------------------------------

@query("head_ordered")
def q_head_ordered(spark, sf_dir):
    """The first 10 rows of duplicate groups in key order (the display of groups)."""
    m = measurements(spark, sf_dir)
    dup = keys.duplicate_members(m.select(*LINEITEM_ORDER, "l_quantity"), LINEITEM_KEY)
    return keys.head_ordered(dup, LINEITEM_KEY + LINEITEM_ORDER, 10)


@query("last_identical_pair")
def q_last_identical_pair(spark, sf_dir):
    """The last identical pair (i, j) in pair order (the workflow shows index -1)."""
    groups = cut_lineage(sim.identical_groups(train_fps(spark, sf_dir), "doc_id"))
    last_i = keys.head_ordered(groups, ["doc_id"], 1, desc=True).select(
        F.col("doc_id").alias("i"), "twin_group")
    members = groups.select(F.col("doc_id").alias("j"), "twin_group")
    pairs = last_i.join(members, "twin_group").where(F.col("i") != F.col("j"))
    return keys.head_ordered(pairs.select("i", "j"), ["i", "j"], 1, desc=True)


@query("stage_shapes")
def q_stage_shapes(spark, sf_dir):
    """Rows and columns through the consensus stages."""
    m = measurements(spark, sf_dir)
    clean = cons.consensus(m, LINEITEM_KEY, LINEITEM_ENDPOINTS, LINEITEM_ORDER,
                           keep=["l_orderkey", "l_linenumber", "l_returnflag"])
    dup = keys.duplicate_members(m, LINEITEM_KEY)
    return (keys.shape(m, "measurements").unionByName(keys.shape(dup, "duplicate_members"))
            .unionByName(keys.shape(clean, "consensus")))


@query("fold_files")
def q_fold_files(spark, sf_dir):
    """All folds written in one pass (one folder per fold) and read back."""
    folds = splits.kfold(_clean_keys(spark, sf_dir).select(*LINEITEM_KEY), LINEITEM_KEY, N_FOLDS, RANDOM_SEED)
    path = sources.scratch_path(spark, "folds")
    sources.write_folds(folds, path, fmt="parquet")
    back = spark.read.parquet(path)
    return back.select(*LINEITEM_KEY, F.col("fold").cast("int").alias("fold"), "split")
