"""Sources, evaluation, dataset building, variation, reports, whole runs, streaming, command line."""

import json
import pickle
import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from strandline import cli
from strandline.operators import matching
from strandline.plans import config, evaluation, figure, report, translations, variation, versions
from strandline.plans.run import run, timer
from strandline.sources import tables
from strandline.streaming import screen


# sources ---------------------------------------------------------------------------------------------------


def test_normalize_and_sets(spark, tmp_path):
    raw = spark.createDataFrame([("a", "d", "f", "one  two", {"k": 1}), ("b", "d", "f", None, None)], "doc_id string, dataset string, family_id string, text string, meta_json map<string,int>")
    got = tables.normalize_docs(raw).orderBy("doc_id").collect()
    assert tables.normalize_docs(raw).columns == tables.COLUMNS and len(tables.COLUMNS) == 12
    assert (got[0]["num_chars"], got[0]["num_words"], got[0]["meta_json"], got[0]["variant_type"]) == (8, 2, '{"k":1}', "original")
    assert (got[1]["text"], got[1]["num_words"], got[1]["meta_json"], got[1]["version_index"]) == ("", 0, "{}", None)
    with pytest.raises(ValueError, match="repeated doc_id"):
        tables.normalize_docs(raw.union(raw))
    with pytest.raises(ValueError, match="lacks"):
        tables.normalize_docs(raw.drop("text"))
    tables.save_set(raw, str(tmp_path), "one")
    tables.save_set(raw.where("doc_id = 'a'").withColumn("text", F.lit("other")), str(tmp_path), "two")
    assert tables.load_set(spark, str(tmp_path), "one").schema.fieldNames() == tables.COLUMNS
    both = {r["doc_id"]: r["text"] for r in tables.concat_sets(spark, str(tmp_path), ["two", "one"]).collect()}
    assert both == {"a": "other", "b": ""}
    with pytest.raises(FileNotFoundError):
        tables.load_set(spark, str(tmp_path), "none")
    with pytest.raises(ValueError):
        tables.concat_sets(spark, str(tmp_path), [])
    assert json.loads(tables.save_json({"é": object}, tmp_path / "deep" / "x.json").read_text(encoding="utf-8"))["é"]
    tables.save_csv(raw.select("doc_id"), tmp_path / "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_records(spark, tmp_path):
    recs = [{"name": "P 1", "title": "T", "abstract": "A", "fulltext": "B  b", "keywords": "k"}, {"name": "", "title": "x", "abstract": "", "fulltext": ""}]
    (tmp_path / "a.json").write_text(json.dumps(recs, indent=1))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, recs)))
    (tmp_path / "c.json").write_text(" \n")
    for name in ("a.json", "b.jsonl"):
        docs = tables.keyphrase_docs(tables.read_records(spark, str(tmp_path / name)), source=name).collect()
        assert [(d["doc_id"], d["text"]) for d in docs] == [("krapivin:p_1:orig", "T\n\nAbstract\nA\n\nB b")]
        assert json.loads(docs[0]["meta_json"])["keywords"] == "k"
    assert tables.read_records(spark, str(tmp_path / "c.json")).count() == 0
    with pytest.raises(ValueError, match="file_name"):
        tables.keyphrase_docs(spark.createDataFrame([("a", "b")], "file_name string, body string"))
    tables.prepare_keyphrases(spark, str(tmp_path / "a.json"), str(tmp_path))
    assert tables.load_set(spark, str(tmp_path), "krapivin_original").count() == 1


def test_works_and_splits(spark, tmp_path):
    works = {"w_ru": {"gt_paras": ["a"], "source_paras": ["b"], "translator_data": {"translator_1": {"translator_paras": ["c"]}}}}
    (tmp_path / "w.pkl").write_bytes(pickle.dumps(works))
    with pytest.raises(ValueError, match="trust"):
        tables.read_works(spark, str(tmp_path / "w.pkl"))
    assert tables.read_works(spark, str(tmp_path / "w.pkl"), trust_pickle=True).first()["translators"] == {"translator_1": ["c"]}
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(str(tmp_path / "x"))
    spark.createDataFrame([(3,)], "a int").write.parquet(str(tmp_path / "y"))
    assert sorted(tuple(r) for r in tables.read_splits(spark, {"train": str(tmp_path / "x"), "test": str(tmp_path / "y")}).select("a", "split").collect()) == [(1, "train"), (3, "test")]


# evaluation ------------------------------------------------------------------------------------------------


def plain_metrics(labels, scores):
    p, n = sum(labels), len(labels) - sum(labels)
    if not p or not n:
        return None
    best, ap, last = (-1.0,), 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        tp = sum(y for y, s in zip(labels, scores) if s >= t)
        fp = sum(1 - y for y, s in zip(labels, scores) if s >= t)
        pr, re = tp / (tp + fp), tp / p
        ap += (re - last) * pr
        last = re
        best = max(best, (2 * pr * re / (pr + re + 1e-12), -t))
    pairs = [(a, b) for a, y in zip(scores, labels) if y for b, z in zip(scores, labels) if not z]
    return best[0], -best[1], ap, sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)


@pytest.mark.parametrize(("labels", "scores"), [([1, 0, 1, 0], [0.9, 0.9, 0.5, 0.1]), ([1, 1], [0.1, 0.2]), ([0], [0.5]), ([1, 0, 0, 1, 1], [0.5] * 5), *(([random.Random(s).randrange(2) for _ in range(200)], [random.Random(s + 1 + i).randrange(40) / 7 for i in range(200)]) for s in (1, 2))])
def test_sweep(spark, labels, scores):
    rows = spark.createDataFrame([(bool(y), float(s), i % 2) for i, (y, s) in enumerate(zip(labels, scores))], "is_positive boolean, score double, g int")
    r = evaluation.sweep(evaluation.curve(rows)).first()
    want = plain_metrics(labels, scores)
    if want is None:
        assert all(r[c] is None for c in ("best_f1", "best_threshold", "pr_auc", "roc_auc"))
    else:
        assert [r[c] for c in ("best_f1", "best_threshold", "pr_auc", "roc_auc")] == pytest.approx(list(want))
        points = evaluation.roc_points(evaluation.curve(rows)).orderBy("threshold").collect()
        assert points[0]["fpr"] == points[0]["tpr"] == 1.0
    for g in evaluation.sweep(evaluation.curve(rows, by=["g"]), ["g"]).collect():
        own = plain_metrics(*map(list, zip(*[(y, s) for i, (y, s) in enumerate(zip(labels, scores)) if i % 2 == g["g"]])))
        assert (g["best_f1"] is None) if own is None else (g["best_f1"] == pytest.approx(own[0]))


def test_known_area(spark):
    rows = spark.createDataFrame([(True, 0.9), (False, 0.9), (True, 0.5), (False, 0.1)], "is_positive boolean, score double")
    assert evaluation.sweep(evaluation.curve(rows)).first()["roc_auc"] == 0.625


def test_evaluate(spark):
    d = lambda rows: spark.createDataFrame(rows, "doc_id string, family_id string")
    truth = evaluation.manifest(d([("p1", "f1"), ("p2", "f2"), ("p3", "f3")]), d([("b1", "f4"), ("b2", "f5")]))
    matches = spark.createDataFrame([("p1", "f1", "r1", "f1", 0.9), ("p2", "f2", "r1", "f1", 0.8), ("b1", "f4", "r1", "f1", 0.8), ("b2", "f5", None, None, 0.0)], matching.MATCHES)
    m, rows = evaluation.evaluate(truth, matches)
    assert m["threshold"] == m["detection_best"]["best_threshold"]
    assert m["separability"]["positive_ratio"] == 0.6
    m, rows = evaluation.evaluate(truth, matches, threshold=0.5)
    assert {k: m["detection"][k] for k in ("tp", "fp", "tn", "fn")} == {"tp": 2, "fp": 1, "tn": 1, "fn": 1}
    assert m["attribution"] == {"family_acc_on_all_positive": pytest.approx(1 / 3), "family_acc_on_detected_positive": 0.5}
    errors = {r["family_id"]: r for r in evaluation.errors_by_family(rows).collect()}
    assert (errors["f1"]["n_false_attraction"], errors["f1"]["attribution_rate"], errors["f2"]["detection_rate"], errors["f2"]["attribution_rate"], errors["f3"]["detection_rate"]) == (1, 1.0, 1.0, 0.0, 0.0)
    assert [r["query_doc_id"] for r in evaluation.false_positives(rows).collect()] == ["b1"]
    two = spark.createDataFrame([("a", True, "f", True, "f"), ("b", True, "f", False, None)], "query_doc_id string, is_positive boolean, target_family_id string, pred_detected boolean, pred_family_id string")
    r = evaluation.errors_by_family(two).first()
    assert (r["detection_rate"], r["attribution_rate"]) == (0.5, 1.0)  # of the detected ones
    one, _ = evaluation.evaluate(truth.where("is_positive"), matches)
    assert one["threshold"] == 0.5 and one["detection_best"]["best_f1"] is None


# versions --------------------------------------------------------------------------------------------------


def test_versions(spark, tmp_path):
    pair = "`id_version_1` string, `text-sentence-1` string, `type-sentence-1` string, `num_sentence-sentence-1` string, `id_version_2` string, `id-sentence-2` string, `text-sentence-2` string, `type-sentence-2` string, `num_sentence-sentence-2` string"
    rows = [
        ("v1", "The  Title", "article-title", "1", "v2", "s1", "New Title", "title", "1"),
        ("v1", "Abstract", "abstract", "2", "v2", "s2", "first", "abstract", "2"),
        ("v1", "about", "abstract", "3", "v2", "s3", "second", "abstract", "3"),
        ("v1", "body", "paragraph", "x", "v2", "s4", "body", "p", "4"),
        ("v1", "note", "footnote", "9", "v2", "s4", "body again", "p", "5"),
        (None, "lost", "p", "1", "v3", None, "only", "p", "1"),
    ]
    pairs = spark.createDataFrame(rows, pair)
    texts = {r["version_id"]: (r["text"], r["num_sent_rows"]) for r in versions.version_texts(pairs).collect()}
    assert texts == {"v1": ("The Title\n\nAbstract\nabout\n\nbody", 3), "v2": ("New Title\n\nAbstract\nfirst\n\nsecond\n\nbody", 4), "v3": ("only", 1)}
    mapping = spark.createDataFrame([("f1", '["v2", "v1"]', "train"), ("f2", "['v3','v2']", "test")], "id_forum string, references string, split string")
    metadata = spark.createDataFrame([("v2", "f1", "20", None, '{"paperhash": "h"}'), ("v1", "", None, "10", None)], "id string, forum string, cdate string, tcdate string, content string")
    links = {r["version_id"]: r["forum_from_mapping"] for r in versions.forum_links(mapping.coalesce(1)).collect()}
    assert links == {"f1": "f1", "f2": "f2", "v1": "f1", "v2": "f1", "v3": "f2"}
    meta = {r["version_id"]: (r["forum_id"], r["version_ts"]) for r in versions.version_meta(versions.version_texts(pairs), mapping.coalesce(1), metadata).collect()}
    assert meta == {"v1": ("f1", 10.0), "v2": ("f1", 20.0), "v3": ("f2", None)}
    signals = {r["forum_id"]: (r["text"][:4], r["date"], r["paperhash"], r["split"]) for r in versions.forum_signals(versions.version_texts(pairs), mapping.coalesce(1), metadata).collect()}
    assert signals == {"f1": ("New ", 20, "h", "train"), "f2": ("only", None, "", "test")}
    docs, log, raw = versions.build_versions(pairs, mapping.coalesce(1), metadata)
    got = {r["doc_id"]: r for r in raw.collect()}
    assert set(got) == {"casimir:f1:v1", "casimir:f1:v2", "casimir:f2:v1"} and log.count() == 0 and docs.count() == 3
    assert got["casimir:f1:v2"]["source_doc_id"] == "casimir:f1:v1" and got["casimir:f1:v1"]["variant_type"] == "original"
    assert json.loads(got["casimir:f2:v1"]["meta_json"]) == {"forum_id": "f2", "raw_version_id": "v3", "split": "test", "version_ts": None, "num_sent_rows": 1}
    assert [df.count() for df in versions.revision_sets(raw)] == [1, 1, 1]
    sizes = versions.prepare_versions(pairs, mapping.coalesce(1), metadata, str(tmp_path))
    assert sizes["casimir_raw_v1_only"] == 1 and sizes["dropped_forums"] == 0 and len(sizes) == 7


def test_translations(spark, tmp_path):
    rows = [("book_2_x_ru", ["m2"], ["s2"], {"translator_1": ["b"], "translator_2": [" "]}), ("book_10_x_ru", ["m10", ""], [], {"translator_1": ["c"], "translator_3": ["only here"]}), ("alone_de", ["m"], [], {"translator_2": ["t"]}), ("solo_1_fr", ["q"], [], {})]
    works = spark.createDataFrame(rows, tables.WORKS)
    machine, human = translations.translation_docs(works)
    got = {r["doc_id"]: (r["text"], r["version_index"]) for r in machine.union(human).collect()}
    assert got == {"book_ru__gt": ("m2\nm10", 0), "book_ru__translator_1": ("b\nc", 1), "book_ru__translator_3": ("only here", 3), "alone_de__gt": ("m", 0), "alone_de__translator_2": ("t", 1), "solo_1_fr__gt": ("q", 0)}
    assert json.loads(machine.where("family_id = 'book_ru'").first()["meta_json"])["lang_name"] == "Russian"
    assert translations.translation_docs(works, merge=False)[0].count() == 4
    assert len(translations.prepare_translations(works, str(tmp_path))) == 6
    assert tables.load_set(spark, str(tmp_path), "par3_human_t1").count() == 1


def test_variation(spark):
    with pytest.raises(ValueError, match="lex"):
        variation.Variation(lex=50)
    how = variation.Variation(lex=40, order=0, sentences=2, max_tokens=14)
    assert how.control == "lexical = 60, order = 100"
    assert variation.sentences("One two.  Three? Four e.g. five!\nSix") == ["One two.", "Three?", "Four e.g. five!", "Six"]
    asked = []

    def rewrite(texts):
        asked.append(texts)
        return [t.split("<sent> ")[1].split(" </sent>")[0].lower() for t in texts]

    assert variation.rewritten(["A b. C d. E f.", "G."], rewrite, how) == ["a b. c d. e f.", "g."]
    assert [len(a) for a in asked] == [2, 1] and asked[1][0].startswith("lexical = 60, order = 100") and "<sent> E f. </sent>" in asked[1][0]
    assert variation.fitted("c", ["a a a", "b"], "w", 3, lambda s: len(s.split())) == "c b w"
    assert variation.fitted("c", ["a"], "w w w", 1, lambda s: len(s.split())) == "c w w w"
    docs = tables.normalize_docs(spark.createDataFrame([("d1", "s", "f", "Ab"), ("d2", "s", "f", None)], "doc_id string, dataset string, family_id string, text string"))
    got = {r["doc_id"]: r for r in variation.variants(docs, lambda ts: [t.upper() for t in ts], batch=2).collect()}
    assert got["d1__dipper_lex60_order60_s42"]["text"] == "AB" and got["d1__dipper_lex60_order60_s42"]["source_doc_id"] == "d1" and len(got) == 2


# runs and reports ------------------------------------------------------------------------------------------


def test_config():
    cfg = config.RunConfig("krapivin", method="bm25")
    assert cfg.ident() == "bm25__krapivin_original__s42" and cfg.folder("A/b") == "artifacts/runs/bm25__krapivin_original__s42/ab"
    other = config.RunConfig("krapivin", variant_sets=["x"], include_original_as_positive=True)
    assert other.ident().startswith("vector__krapivin_original__s42__var") and other.ident().endswith("__inclorig")
    assert [c.method for c in config.configs({"dataset": "par3", "runs": [{"method": "bm25"}, {"method": "fuzzy"}]})] == ["bm25", "fuzzy"]
    names = [config.RunConfig("krapivin", **kw).ident() for kw in ({}, {"split_ratio": 0.3}, {"split_seed": 7}, {"method_params": {"k1": 2}}, {"method_params": {"k1": 3}}, {"variant_sets": ["x"]}, {"include_original_as_positive": True})]
    assert len(set(names)) == len(names) and names[1].endswith("__r0.3")
    assert cfg.as_dict()["_resolved"]["run_ident"] == cfg.ident()
    for bad in ({"dataset": "x"}, {"dataset": "par3", "method": "x"}):
        with pytest.raises(ValueError):
            config.RunConfig(**bad)


def test_run_and_reports(spark, tmp_path, capsys):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    originals = [(f"k:p{i}:orig", "krapivin", f"k:p{i}", " ".join(rng.choices(words, k=60))) for i in range(12)]
    variants = [(f"{d}__x", s, f, " ".join(rng.sample(t.split(), 50)), d) for d, s, f, t in originals]
    prepared, artifacts = str(tmp_path / "prepared"), str(tmp_path / "artifacts")
    schema = "doc_id string, dataset string, family_id string, text string"
    tables.save_set(spark.createDataFrame(originals, schema), prepared, "krapivin_original")
    tables.save_set(spark.createDataFrame(variants, schema + ", source_doc_id string"), prepared, "krapivin_original_dipper_lex60_order60_s42")
    common = {"prepared_dir": prepared, "splits_dir": str(tmp_path / "splits"), "artifacts_dir": artifacts}
    spec = tmp_path / "runs.yaml"
    spec.write_text(json.dumps({"dataset": "krapivin", **common, "runs": [{"method": "bm25"}, {"method": "fuzzy"}]}))
    assert cli.main(["run", str(spec)]) == 0
    m = run(spark, config.RunConfig("krapivin", **common), tag="qwen3-test")
    assert m["counts"] == {"n_ref_docs": 6, "n_query_docs": 24 - 6, "n_positive": 6, "n_benign": 12}
    runs = report.metrics_table(spark, artifacts)
    assert runs.count() == 3 and runs.where("method = 'bm25'").first()["best_f1"] == pytest.approx(1.0)
    t = {r["label"]: r["Krapivin paraphrase"] for r in report.result_table(runs).collect()}
    assert t["BM25"] == 1.0 and t["Vector (Granite 97M)"] is None and len(t) == 5
    assert cli.main(["table", "--artifacts", artifacts, "--csv", str(tmp_path / "t")]) == 0 and spark.read.csv(str(tmp_path / "t"), header=True).count() == 10
    assert {r["dataset"]: (r["docs"], r["variants"]) for r in report.corpus_table(spark, prepared, artifacts, "m").collect()} == {"krapivin": (12, 12)}
    assert {r["label"] for r in report.roc_table(spark, artifacts, panels=("krapivin",)).collect()} >= {"BM25"}
    areas = figure.roc_figure(spark, artifacts, str(tmp_path / "f" / "roc.svg"), panels=("krapivin", "par3"))
    assert areas["krapivin"]["BM25"] == 1.0 and "par3" not in areas
    drawing = ElementTree.parse(tmp_path / "f" / "roc.svg").getroot()
    assert len(drawing.findall("{http://www.w3.org/2000/svg}polyline")) == len(areas["krapivin"])
    run(spark, config.RunConfig("krapivin", method="bm25", split_seed=7, **common))
    with pytest.raises(ValueError, match="matches 2 runs"):
        report.result_table(report.metrics_table(spark, artifacts))
    with pytest.raises(ValueError):
        report.run_of(report.metrics_table(spark, artifacts), "krapivin", "bm25", None)
    assert report.metrics_table(spark, str(tmp_path / "none")).count() == 0
    assert cli.main(["quality", "krapivin_original", "krapivin_original_dipper_lex60_order60_s42", "--prepared", prepared]) == 0
    assert "n_docs" in capsys.readouterr().out


def test_prorated_cost_and_cache(spark, tmp_path):
    costs = spark.createDataFrame([("s", 10.0), ("t", 4.0)], "set_name string, sec double")
    members = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "c"), ("t", "d"), ("t", "e"), ("t", "f")], "set_name string, doc_id string")
    used = spark.createDataFrame([("a",), ("c",), ("c",)], "doc_id string")
    assert {r["set_name"]: r["seconds"] for r in report.prorated_cost(costs, members, used).collect()} == {"s": 5.0, "t": 1.0}
    docs = tables.normalize_docs(spark.createDataFrame([("a", "d", "f", "x y")], "doc_id string, dataset string, family_id string, text string"))
    calls = spark.sparkContext.accumulator(0)

    def encode(texts):
        calls.add(1)
        return [[1.0, 2.0]] * len(texts)

    for _ in range(2):
        assert matching.encoded_set(spark, docs, str(tmp_path), "s", "m/x", encode, 8).count() == 1
    assert calls.value == 1
    with timer() as t:
        pass
    assert t["sec"] >= 0


# streaming -------------------------------------------------------------------------------------------------


def test_screening_stream(spark, tmp_path):
    schema = "doc_id string, family_id string, text string, ts timestamp"
    ref = tables.normalize_docs(spark.createDataFrame([("r1", "d", "f1", "secret plan alpha beta"), ("r2", "d", "f2", "gamma delta")], "doc_id string, dataset string, family_id string, text string"))
    incoming = str(tmp_path / "in")
    rows = [("q1", "x", "the secret plan alpha", "2024-01-01 00:00:00"), ("q1", "x", "the secret plan alpha", "2024-01-01 00:01:00"), ("q2", "y", "nothing at all", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "doc_id string, family_id string, text string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(incoming)
    stream = spark.readStream.schema(schema).parquet(incoming)
    screen.screen(ref, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["query_doc_id"], r["pred_doc_id"]) for r in got] == [("q1", "r1")]
    q = screen.volume(stream).writeStream.format("memory").queryName("volume").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("volume").collect()) == [1, 2]
