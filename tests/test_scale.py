"""Skew paths give the same rows as the plain ones, and plans have the wanted shape."""

import json
import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lurelog import schema
from lurelog.operators import clusters, dedup, features, forest, ip_windows, labels, metrics
from lurelog.operators import kmeans as km
from lurelog.operators import normalize, projection, quantiles, sessions, skew, sweeps
from lurelog.plans import cluster as cluster_plan
from lurelog.plans import detect
from lurelog.sinks import files
from lurelog.sources.tables import load_table, read_csv_table
from lurelog.workload import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return catalog.events(catalog.configure(spark), SF)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(repr, df.collect()))


def test_gaps_of_hot_keys_and_bursts(spark):
    # One address holds most rows, and half of them share one microsecond.
    base = spark.range(3000).selectExpr(
        "timestamp_micros(cast(CASE WHEN id % 2 = 0 THEN 5 ELSE id * id % 100003 * 7000 END AS BIGINT)) AS ts_utc",
        "CASE WHEN id % 5 = 0 THEN 'b' ELSE 'a' END AS source", "'ssh' AS service",
        "CASE WHEN id % 10 < 8 THEN 'hot' ELSE concat('cold', id % 7) END AS src_ip_hash", "sha(string(id)) AS event_hash")
    whole = Window.partitionBy(*ip_windows.GAP_KEY).orderBy("ts_utc", "source")
    plain = base.withColumn("gap_us", F.unix_micros("ts_utc") - F.unix_micros(F.lag("ts_utc").over(whole)))
    dealt = ip_windows.with_gaps(base)
    seen = [c for c in sorted(plain.columns) if c != "event_hash"]  # which of two equals comes first is open
    assert rows(plain.select(seen)) == rows(dealt.select(seen))
    ranged = skew._ranged(base, ip_windows.GAP_KEY, ["ts_utc", "source"])
    largest = ranged.groupBy("_range").count().agg(F.max("count")).first()[0]
    assert largest < 1000  # a fraction of the hot key


def test_ranges_are_found_without_interpreted_loops(spark):
    cuts = [3, 4, 10, 11, 50]
    made = ", ".join(f"struct({cut}L AS a)" for cut in cuts)
    keys = spark.range(60).selectExpr("struct(id AS a) AS at", f"array({made}) AS cuts")
    placed = skew.with_range(keys, "at", "cuts", "n")
    assert [r["n"] for r in placed.orderBy("at").collect()] == [sum(c <= i for c in cuts) for i in range(60)]
    logins = spark.range(100).selectExpr("timestamp_micros(id) AS t", "concat('k', id % 3) AS k")
    assert "lambda" not in plan_of(skew.with_previous(logins, ["k"], ["t"], "t", "before"))


def test_methods_that_the_jvm_would_interpret_are_not_used(spark):
    catalog.configure(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_positions_of_a_hot_key(spark):
    base = spark.range(2000).selectExpr("CASE WHEN id % 10 < 8 THEN 'hot' ELSE concat('k', id % 7) END AS k", "id * 37 % 2003 AS at")
    whole = Window.partitionBy("k").orderBy("at")
    plain = base.withColumn("n", (F.row_number().over(whole) - 1).cast("long"))
    assert rows(plain) == rows(skew.with_position(base, ["k"], ["at"], "n"))
    empty = skew.with_position(base.limit(0), ["k"], ["at"], "n")
    assert empty.columns == plain.columns and empty.count() == 0


def test_windows_with_one_shuffle_of_logins_before_counting(events):
    plan = plan_of(ip_windows.with_gaps(ip_windows.login_events(events)))
    assert plan.count("Exchange hashpartitioning") == 1 and "raw_json" not in plan


def test_copies_are_dropped_before_the_shuffle(events):
    plan = plan_of(dedup.dedup_events(events))
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_dedup_keeps_one_row_of_a_group_of_copies(spark, events):
    copies = events.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("i")
    assert rows(dedup.dedup_events(copies)) == rows(events)


def test_items_hold_all_commands(events):
    whole = sessions.build_sessions(events)
    items = catalog.staged(sessions.session_items(events), "items")
    counted = whole.agg(F.sum("num_commands")).first()[0]
    assert items.where("command IS NOT NULL").count() == counted
    chunks = sessions.session_chunks(items, 2)
    assert chunks.agg(F.sum(F.coalesce(F.size("commands_seq"), F.lit(0)))).first()[0] == counted
    assert chunks.agg(F.max(F.size("commands_seq"))).first()[0] <= 2


def test_a_huge_session_keeps_its_terms(spark):
    # One session of 20,000 commands beside small ones.
    items = spark.range(20_300).selectExpr(
        "CASE WHEN id < 20000 THEN 'huge' ELSE concat('s', id % 100) END AS session_id", "id AS position",
        "concat(element_at(array('ls', 'cat', 'wget'), cast(id % 3 + 1 AS INT)), ' x') AS command")
    counted = {(r.doc_id, r.term): r.tf for r in clusters.item_term_counts(items).collect()}
    assert counted["huge", "ls"] == 6667 and counted["huge", "ls cat"] == 6667 and counted["huge", "wget ls"] == 6666


def test_item_terms_equal_document_terms(events):
    items = catalog.staged(sessions.session_items(events), "items")
    lists = items.groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "command"))), lambda e: e["command"]).alias("all"))
    docs = clusters.session_docs(lists.select("session_id", F.filter("all", lambda c: c.isNotNull()).alias("commands_seq")))
    from_docs = clusters.term_counts(docs).select("doc_id", "term", "tf")
    assert rows(from_docs) == rows(clusters.item_term_counts(items).select("doc_id", "term", "tf"))


def test_commands_that_share_200_characters_stay_two_events(spark):
    start = "echo " + "a" * 300
    line = '{"eventid":"cowrie.command.input","timestamp":"2025-01-02T03:04:05Z","session":"s","input":"%s"}'
    lines = spark.createDataFrame([("f", line % (start + end)) for end in ("1", "2")], "file STRING, value STRING")
    found = normalize.valid_events(normalize.normalize_cowrie(lines, salt="x", redact_free_text=True))
    assert dedup.dedup_events(found).count() == 2


def test_lookup_join_equals_a_join(spark):
    left = spark.range(2000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 90) END AS term")
    table = spark.range(60).selectExpr("CASE WHEN id = 0 THEN 'hot' ELSE concat('t', id) END AS term", "CASE WHEN id = 0 THEN 667 ELSE 15 END AS df")
    got = skew.lookup_join(left, table, "term", "df", part=1 / 200)
    assert rows(got.select("id", "term", "df")) == rows(left.join(table, "term").select("id", "term", "df"))


@pytest.mark.parametrize("by", [None, "g"])
def test_bracketed_quantiles(spark, by):
    data = spark.range(5000).selectExpr("id % 3 AS g", "CASE WHEN id % 11 > 0 THEN pow(id % 997, 3) / 7 END AS x")
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    found = quantiles.exact_quantiles(data, ["x"], probs, by, accuracy=200).collect()
    plain = data.toPandas().dropna()
    groups = {None: plain} if by is None else dict(iter(plain.groupby("g")))
    assert len(found) == len(probs) * len(groups)
    for r in found:
        wanted = np.quantile(groups[r["g"] if by else None]["x"], r["prob"])
        assert math.isclose(r["value"], wanted, rel_tol=1e-12)


def test_sweep_reads_the_data_without_multiplying_it(spark, events):
    windows = catalog.staged(ip_windows.build_ip_windows(events, 1440), "w")
    feats = catalog.staged(features.engineer_features(windows), "f")
    plan = plan_of(sweeps.rule_sweep(feats, F.lit(1)))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.index("Generate") < plan.index("HashAggregate", plan.index("Generate"))
    swept = sweeps.rule_sweep(feats, F.expr("cast(success_count > 0 AS INT)"), attempts=[1, 2], users=[2], passwords=[2], gaps=[-1.0, 1e6])
    for r in swept.collect():
        pred = features.rule(r.attempts_ge, r.unique_users_ge, r.unique_passwords_ge, r.max_mean_interarrival_s)
        got = feats.select(pred.alias("p"), (F.col("success_count") > 0).cast("int").alias("y")).toPandas()
        assert r.alerts_full_count == got.p.sum() and r.sample_tp == ((got.p == 1) & (got.y == 1)).sum()


def test_sample_of_unaligned_windows(spark, events):
    sample = events.filter("src_ip_hash IS NOT NULL").limit(20).select(
        (F.col("ts_utc") - F.expr("INTERVAL 7 MINUTES")).alias("window_start"), "source", "service", "src_ip_hash").distinct()
    got = labels.context_counts(labels.events_in_windows(sample, events, 90)).toPandas()
    frame = events.toPandas()
    assert len(got)
    for r in got.itertuples():
        m = frame[(frame.source == r.source) & (frame.service == r.service) & (frame.src_ip_hash == r.src_ip_hash)
                  & (frame.ts_utc >= r.window_start) & (frame.ts_utc < r.window_start + np.timedelta64(90, "m"))]
        assert len(m) == r.events_in_window


def planted(spark, n=2000):
    cols = features.FOREST_FEATURES
    base = spark.range(n, numPartitions=3)
    noise = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0).alias(c) for i, c in enumerate(cols)]
    key = [F.timestamp_seconds("id").alias("window_start"), F.lit("s").alias("source"), F.lit("v").alias("service"),
           F.col("id").cast("string").alias("src_ip_hash")]
    far = F.when(F.col("id") < 5, F.lit(40.0)).otherwise(F.lit(0.0))
    return base.select("id", *key, *noise).withColumns({c: F.col(c) + far for c in cols})


def test_forest_finds_planted_outliers_at_any_partitioning(spark):
    df = planted(spark)
    one = forest.isolation_forest(df.repartition(1), 0.01)
    many = forest.isolation_forest(df.repartition(8), 0.01)
    assert rows(one.select("id", F.round("if_score", 9), "if_pred")) == rows(many.select("id", F.round("if_score", 9), "if_pred"))
    worst = [r.id for r in one.orderBy("if_score").limit(5).collect()]
    assert sorted(worst) == [0, 1, 2, 3, 4]
    assert one.filter("if_pred = 1").count() == 20


def test_forest_samples_are_exact(spark):
    drawn = forest._tree_samples(planted(spark), features.FOREST_FEATURES, schema.WINDOW_KEY, 200, 256, 1, 2000)
    sizes = drawn.groupBy("tree").count().collect()
    assert len(sizes) == 200 and {r["count"] for r in sizes} == {256}


TERMS = dict(min_df=1, max_df=1.0)


def talk(spark, texts):
    sessions_ = spark.createDataFrame([(f"s{i}", len(t)) for i, t in enumerate(texts)], "session_id STRING, num_commands INT")
    items = spark.createDataFrame([(f"s{i}", k, c) for i, t in enumerate(texts) for k, c in enumerate(t)], "session_id STRING, position LONG, command STRING")
    return sessions_, items


def test_vectors_clusters_and_projection(spark):
    texts = [["ls", "cat x", "ls"], ["ls", "cat y", "ls"], ["wget a", "curl b", "chmod c"], ["wget q", "curl r", "chmod s"]] * 4
    texts[5] = ["ls", "cat", "id", "ls"]
    data, items = talk(spark, texts)
    found = cluster_plan.cluster_sessions(data, items, k=2, **TERMS)
    assigned = {r.session_id: r.cluster for r in found["sessions"].collect()}
    assert len(assigned) == 16 and len({assigned["s0"], assigned["s2"]}) == 2
    assert all(assigned[f"s{i}"] == assigned[f"s{i % 4 // 2 * 2}"] for i in range(16))
    assert sorted(r.n_sessions for r in found["summary"].collect()) == [8, 8]
    xy = found["coords"].orderBy("doc_id").toPandas()
    assert abs(xy.x.sum()) < 1e-9 and abs(xy.y.sum()) < 1e-9

    docs = data.select(F.col("session_id").alias("doc_id"))
    matrix = clusters.term_matrix(clusters.item_tokens(items), 16, **TERMS)
    matrix = matrix._replace(weights=catalog.staged(matrix.weights, "w"))
    table = matrix.weights.toPandas()
    names = sorted(r.doc_id for r in docs.collect())
    assert sorted(r.idx for r in matrix.terms.collect()) == list(range(matrix.terms.count()))
    dense = np.zeros((16, matrix.terms.count()))
    dense[[names.index(d) for d in table.doc_id], table.idx] = table.weight
    assert np.allclose((dense**2).sum(axis=1), 1.0)
    centred = dense - dense.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(xy.x), np.abs(u[:, 0] * s[0]), atol=1e-6)
    assert np.allclose(np.abs(xy.y), np.abs(u[:, 1] * s[1]), atol=1e-5)
    plan = plan_of(found["coords"])
    assert "Python" not in plan and "Pandas" not in plan


def said(spark):
    """Documents with repeated and null identifiers, null and empty texts, and what they count by plain code."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(w)}" for w in rng.zipf(1.4, 30) if w < 500) for _ in range(80)] + [None, "", "x", "only-here é-ab a"]
    ids = [None if i % 29 == 7 else i - i % 2 if i < 20 else i for i in range(len(texts))]
    counts = Counter()
    for doc_id, text in zip(ids, texts):
        words = re.findall(r"\b([a-zA-Z0-9_\-]{2,})\b", text or "")
        counts.update((doc_id, term) for term in [*words, *map(" ".join, zip(words, words[1:]))])
    df = Counter(term for _, term in counts)
    raw = {k: tf * (math.log((1 + len(texts)) / (1 + df[k[1]])) + 1) for k, tf in counts.items() if 2 <= df[k[1]] <= 0.8 * len(texts)}
    norms = Counter()
    for (doc_id, _), value in raw.items():
        norms[doc_id] += value * value
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id LONG, doc STRING")
    return docs, {k: value / math.sqrt(norms[k[0]]) for k, value in raw.items()}


def test_weights_of_documents_in_parts(spark):
    docs, wanted = said(spark)
    parts = skew.dealt(docs, "doc_id", "doc", 300)
    tokens = clusters.doc_tokens(parts)
    assert len(tokens.schema["part"].metadata["labels"]) > 20
    assert parts.groupBy(F.spark_partition_id()).agg(F.count_distinct("part").alias("n")).agg(F.max("n")).first()[0] == 1
    matrix = clusters.term_matrix(tokens, docs.count(), **catalog.TERMS)
    found = {(r.doc_id, r.term): r.weight for r in matrix.named().collect()}
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-12 for k in wanted)
    assert matrix.weights.count() == len(wanted) and matrix.terms.count() == len({t for _, t in wanted})
    none = clusters.term_matrix(clusters.doc_tokens(skew.dealt(docs.limit(0), "doc_id", "doc")), 0, **catalog.TERMS)
    assert none.named().count() == 0


def test_no_row_of_a_document_and_a_term_is_shuffled_or_written(spark):
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    found = catalog.QUERIES["session_tfidf"](spark, SF)
    keys = set(re.findall(r"hashpartitioning\((\w+)#", plan_of(found)))
    assert found.count() and keys == {"part", "bucket"}
    assert set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) == before


@pytest.mark.parametrize("likely", [0, 1 / 200, 0.2, 100])
def test_heaviest_terms_of_documents_in_parts(spark, monkeypatch, likely):
    # Too high a first bound leaves out terms, so a second pass must find them.
    monkeypatch.setattr(clusters, "LIKELY_PART", likely)
    docs, weights = said(spark)
    ids = [r.doc_id for r in docs.collect()]
    given = [(i, None if i % 31 == 3 else i % 3) for i in ids if i is not None] + [(4, 2), (4, 2), (None, 1), (999, 0)]
    totals = Counter()
    for doc_id, cluster in given:
        for (other, term), weight in weights.items():
            if doc_id is not None and cluster is not None and other == doc_id:
                totals[cluster, term] += weight
    matrix = clusters.term_matrix(clusters.doc_tokens(skew.dealt(docs, "doc_id", "doc", 300)), docs.count(), **catalog.TERMS)
    found = clusters.top_terms(matrix, spark.createDataFrame(given, "doc_id INT, cluster INT"), 7).collect()
    assert {r.cluster: r.n_sessions for r in found} == Counter(c for _, c in given)
    for r in found:
        best = sorted((-round(v, 9), t) for (c, t), v in totals.items() if c == r.cluster)[:7]
        assert r.top_terms == (", ".join(t for _, t in best) or None)


@pytest.mark.parametrize("k", [3, 6])
def test_kmeans_ends_where_no_document_is_nearer_to_another_centre(spark, k):
    # A vocabulary of a million terms, most of them in one document.
    rng = np.random.default_rng(k)
    cells = []
    for doc in range(240):
        own = {int(t): 1.0 for t in rng.integers(0, 1_000_000, 30)} | {int(t): 3.0 for t in rng.integers(0, 12, 4) + 12 * (doc % 5)}
        norm = math.sqrt(sum(w * w for w in own.values()))
        cells += [(f"d{doc}", t, w / norm) for t, w in own.items()]
    weights = catalog.staged(spark.createDataFrame(cells, "doc_id STRING, idx LONG, weight DOUBLE"), "w")
    docs = spark.createDataFrame([(f"d{i}",) for i in range(242)], "doc_id STRING")  # two without any term
    found = {r.doc_id: r.cluster for r in km.kmeans(weights, docs, k).collect()}
    assert len(found) == 242 and len(set(found.values())) == k and found["d240"] == found["d241"]
    names = sorted(found)
    columns = {t: i for i, t in enumerate(sorted({t for _, t, _ in cells}))}
    x = np.zeros((242, len(columns)))
    for doc, term, weight in cells:
        x[names.index(doc), columns[term]] = weight
    own = np.array([found[d] for d in names])
    centres = np.array([x[own == c].mean(0) for c in range(k)])
    far = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    assert (far[np.arange(242), own] <= far.min(1) + 1e-9).all()


def test_kmeans_of_equal_documents(spark):
    weights = catalog.staged(spark.range(6).selectExpr("concat('d', id) AS doc_id", "5L AS idx", "1D AS weight"), "w")
    docs = weights.select("doc_id")
    assert {r.cluster for r in km.kmeans(weights, docs, 3).collect()} <= {0, 1, 2}
    nothing = weights.where("idx < 0")
    assert km.kmeans(catalog.staged(nothing, "w"), docs, 2).count() == 6


def test_axes_of_a_wide_table(spark):
    # More documents than the basis has columns at first, and a slow decay.
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(0, 1, (150, 90))) * (rng.random((150, 90)) < 0.3) * np.linspace(1, 2, 90)
    weights = catalog.staged(spark.createDataFrame([(i, int(j), float(x[i, j])) for i in range(150) for j in np.flatnonzero(x[i])], "doc_id LONG, idx LONG, weight DOUBLE"), "w")
    docs = spark.range(150).withColumnRenamed("id", "doc_id")
    xy = projection.pca_2d(weights, docs).orderBy("doc_id").toPandas()
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose([xy.x.var(), xy.y.var()], s[:2] ** 2 / 149, rtol=1e-9)
    assert np.allclose(np.abs(xy.x), np.abs(u[:, 0] * s[0]), atol=1e-4) and np.allclose(np.abs(xy.y), np.abs(u[:, 1] * s[1]), atol=1e-4)
    one = projection.pca_2d(catalog.staged(weights.where("doc_id = 0"), "w"), docs.where("doc_id = 0")).first()
    assert (one.x, one.y) == (0.0, 0.0)


def test_hash_clash_is_an_error(spark):
    terms = spark.createDataFrame([("a", 1, 7), ("b", 1, 7)], "term STRING, df LONG, hash LONG")
    with pytest.raises(Exception, match="another term has the hash"):
        clusters._numbered(terms).collect()


def test_draws_cost_nothing_for_rows_without_a_tree(spark):
    rows_ = planted(spark, 20_000)
    drawn = forest._tree_samples(rows_, features.FOREST_FEATURES, schema.WINDOW_KEY, 200, 256, 1, 20_000)
    assert {r["count"] for r in drawn.groupBy("tree").count().collect()} == {256}
    parts = rows_.repartition(7)
    again = forest._tree_samples(parts, features.FOREST_FEATURES, schema.WINDOW_KEY, 200, 256, 1, 20_000)
    assert rows(drawn) == rows(again)
    # Every part of the table serves, each tree with rows of its own.
    assert drawn.select("draw").distinct().count() == 200 * 256


def test_few_sessions(spark):
    data, items = talk(spark, [["ls", "cat", "id"], ["id", "id", "ls"]])
    found = cluster_plan.cluster_sessions(data, items, k=2, **TERMS)
    assert found["sessions"].select("cluster").distinct().count() == 2
    for wrong in (dict(k=3), dict(k=2, min_commands=9)):
        with pytest.raises(ValueError):
            cluster_plan.cluster_sessions(data, items, **TERMS, **wrong)


def test_metrics_conventions(spark):
    data = spark.createDataFrame([("0", "0"), ("0", None), ("x", "1"), ("", "1")], "label STRING, if_pred STRING")
    row = metrics.evaluate(data, "if_pred").first()
    assert (row.n, row.tn, row.precision, row.recall, row.f1) == (2, 2, None, None, None)
    with pytest.raises(Exception, match="no label"):
        metrics.evaluate(data.filter("label = ''"), "if_pred").collect()
    with pytest.raises(ValueError):
        metrics.evaluate(data, "missing")


def test_sample_quotas(spark):
    def frame(n_alert, n_normal):
        return spark.range(n_alert + n_normal).select(
            F.timestamp_seconds("id").alias("window_start"), F.lit("s").alias("source"), F.lit("v").alias("service"),
            F.col("id").cast("string").alias("src_ip_hash"), (F.col("id") < n_alert).cast("int").alias("baseline_alert"),
            F.lit(0).alias("if_pred"))

    for alerts, normal, wanted in [(100, 100, (40, 40)), (10, 100, (10, 70)), (100, 10, (40, 10)), (0, 5, (0, 5))]:
        got = labels.stratified_sample(frame(alerts, normal)).groupBy("baseline_alert").count().collect()
        assert {r.baseline_alert: r["count"] for r in got} == {k: v for k, v in ((1, wanted[0]), (0, wanted[1])) if v}
    first = labels.stratified_sample(frame(100, 100).repartition(1)).collect()
    assert first == labels.stratified_sample(frame(100, 100).repartition(7)).collect()


def test_tune_fits_once_on_the_sample(spark, events):
    windows = catalog.staged(ip_windows.build_ip_windows(events, 1440), "w")
    labelled = windows.withColumn("label", (F.col("attempts") > 2).cast("int").cast("string"))
    swept = detect.tune(labelled, attempts=[1, 3], users=[1], passwords=[2], gaps=[-1.0])
    assert swept.count() == 2 * 5 * 4


def test_detect_writes_all_outputs(spark, events, tmp_path):
    windows = ip_windows.build_ip_windows(events, 1440)
    detect.detect_and_write(windows, str(tmp_path), use_forest=False, attempts_ge=2, unique_users_ge=1)
    for name in ("anomaly_windows.parquet", "top_if_anomalies", "top_baseline_alerts", "anomaly_summary", "label_sample"):
        assert (tmp_path / name).exists()
    document = json.loads(next((tmp_path / "anomaly_summary").glob("part-*")).read_text())
    assert document["baseline"]["attempts_ge"] == 2 and document["baseline"]["unique_passwords_ge"] == 10
    assert document["isolation_forest"]["contamination"] == 0.01 and document["outputs"]["parquet"].endswith("anomaly_windows.parquet")
    assert document["rows_total"] == windows.count() and document["generated_at_utc"].endswith("+00:00")
    with pytest.raises(ValueError):
        detect.detect(windows, service="none")


def test_documents_and_tables_of_tuning(spark, events, tmp_path):
    labelled = spark.createDataFrame([("1", "1"), ("0", "1"), ("1", "0"), ("", "1")], "label STRING, if_pred STRING")
    files.write_csv(labelled, str(tmp_path / "labelled"))
    detect.evaluate_csv(spark, str(tmp_path / "labelled"), "if_pred", str(tmp_path / "eval"))
    document = json.loads(next((tmp_path / "eval").glob("part-*")).read_text())
    assert document["confusion_matrix"] == {"tp": 1, "tn": 0, "fp": 1, "fn": 1} and document["metrics"]["recall"] == 0.5
    assert (document["n"], document["pred_col"]) == (3, "if_pred")
    windows = catalog.staged(ip_windows.build_ip_windows(events, 1440), "w")
    marked = windows.withColumn("label", (F.col("attempts") > 2).cast("int").cast("string"))
    swept = detect.tune_and_write(marked, str(tmp_path / "tuned"), attempts=[1, 3], users=[1], passwords=[2], gaps=[-1.0])
    assert read_csv_table(spark, str(tmp_path / "tuned")).count() == swept.count() == 40
    rule_swept = sweeps.rule_sweep(features.engineer_features(windows), F.expr("cast(attempts > 2 AS INT)"), attempts=[1, 3], users=[1], passwords=[2], gaps=[-1.0])
    files.write_csv(rule_swept.withColumn("sample_recall", F.lit(1.0)), str(tmp_path / "flat"))
    detect.repair_and_write(spark, str(tmp_path / "flat"), str(tmp_path / "fixed"))
    for r in read_csv_table(spark, str(tmp_path / "fixed")).collect():
        wanted = int(r.sample_tp.split(".")[0]) / (int(r.sample_tp.split(".")[0]) + int(r.sample_fn.split(".")[0]))
        assert r.sample_recall == f"{wanted:.6f}" and r.label_text.startswith("a>=")


def test_tables_of_the_catalog(spark, events):
    events.limit(5).createOrReplaceTempView("events")
    try:
        assert load_table(spark, "events", "/nowhere", prefer="catalog").count() == 5
    finally:
        spark.catalog.dropTempView("events")


def test_parts_for_counting_terms_hold_the_same_text_at_any_size(spark):
    held = []
    for n in (200, 2000):
        docs = spark.range(n).selectExpr("id AS doc_id", "repeat('word ', 100) AS text")
        parts = skew.by_size(docs, "doc_id", "text", piece=4000).withColumn("part", F.spark_partition_id())
        held.append(parts.groupBy("part").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0])
    assert held[1] < 3 * held[0]
    empty = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert skew.by_size(empty, "doc_id", "text").count() == 0


def test_documents_are_dealt_by_their_size(spark, monkeypatch):
    monkeypatch.setattr(skew, "by_size", lambda df, key, text: df.repartition(37, key))
    assert catalog.plain_docs(spark, SF).rdd.getNumPartitions() == 37
