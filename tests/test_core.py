"""Core operators: examples, properties and the oracles on the smallest tables."""

import datetime
import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from claimlens import catalog
from claimlens.functions import text as T
from claimlens.functions.lexicon import BANGLA, LATIN
from claimlens.operators import adapters, claims, dataset, dedup, edits, reports, verify
from claimlens.plans import config, pipeline
from claimlens.sources import readers, sinks
from claimlens.streaming import incremental

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    frame = catalog.QUERIES[name](spark, SF)
    result = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)

    def plain(x):
        if isinstance(x, float):
            return "NaN" if math.isnan(x) else round(x, 6)
        return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x

    want = sorted(str([plain(dict(zip(names, r, strict=True))[c]) for c in frame.columns]) for r in result.fetchall())
    assert sorted(str([plain(x) for x in r]) for r in frame.collect()) == want


def test_spans_tile_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, ""), (-2, "...a b! c"), (-3, None)], "doc_id long, text string"))
    rows = docs.select("text", T.sentence_spans(F.col("text"), LATIN).alias("s")).filter("text IS NOT NULL").collect()
    for r in rows:
        want = [(m.start(), m.end(), m[0].strip()) for m in re.finditer(LATIN.sentence, r.text) if m[0].strip()]
        assert [(s["start"], s["end"], s["text"]) for s in r.s] == want
        assert [s["idx"] for s in r.s] == list(range(len(r.s)))


def test_numbers(spark):
    assert one(spark, T.numbers(F.lit("১০ শতাংশ, 1,234,567 এবং 5.5%"))) == ["১০", "1,234", "567", "5.5%"]
    assert one(spark, T.scaled_values(F.lit("৫ কোটি টাকা, ২ লাখ, ৩ হাজার, ৭"), BANGLA)) == [5e7, 2e5, 3e3, 7.0]
    assert one(spark, T.scaled_values(F.lit("১২ দশমিক ৫ শতাংশ"), BANGLA)) == [12.5]
    assert one(spark, T.unit_mismatch(F.lit("৫৬ টাকার"), F.lit("১০০ শতাংশ"), BANGLA)) is not None
    assert one(spark, T.unit_mismatch(F.lit("৫৬ টাকার"), F.lit("৫ কোটি টাকার"), BANGLA)) is None
    assert one(spark, T.unit_mismatch(F.lit("১শ’টির বেশি"), F.lit("১০০ শতাংশ"), BANGLA)) == "numeric_unit_mismatch_count_percentage"


def test_artifacts(spark):
    assert one(spark, T.artifacts(F.lit("কনসালটেন্সি সেবা"), BANGLA)) == []
    assert one(spark, T.artifacts(F.lit("এই কনসা সেবা"), BANGLA)) == ["suspicious_bangla_fragment"]


def test_entities(spark):
    assert one(spark, T.entities(F.lit("বাংলাদেশ ব্যাংক ও সোনালী ব্যাংক জানায়"), BANGLA))[0] == "বাংলাদেশ ব্যাংক"
    assert one(spark, T.same_role(F.lit("সোনালী ব্যাংক"), F.lit("জনতা ব্যাংক"), BANGLA)) is True
    assert one(spark, T.same_role(F.lit("সোনালী ব্যাংক"), F.lit("ডিএসই"), BANGLA)) is False


def test_occurs_as_term(spark):
    cases = [("in 2020 it", "2020", True), ("in 12020 it", "2020", False), ("১০ টাকা", "10", True), ("a.b|c", "b", True), ("x\\Ey", "\\E", False), ("", "", False)]
    for text, span, want in cases:
        assert one(spark, T.occurs_as_term(F.lit(text), F.lit(span), LATIN)) is want, (text, span)


def test_splice_changes_one_sentence(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("a", T.sentence_spans(F.col("text"), LATIN)).filter(F.size("a") > 2)
    s = F.get("a", F.lit(1))
    new = docs.withColumn("b", T.sentence_spans(T.splice(F.col("text"), s["start"], s["end"], F.lit("Zzz qqq.")), LATIN))
    assert {tuple(r.c) for r in new.select(T.changed_indices(F.col("a"), F.col("b")).alias("c")).collect()} == {(1,)}


def test_first_difference_and_small_functions(spark):
    assert one(spark, T.first_difference(F.lit("abcdef"), F.lit("abXdef"), 1)["at"]) == 2
    assert one(spark, T.first_difference(F.lit("same"), F.lit("same"))["at"]) == -1
    assert one(spark, T.human_bytes(F.lit(1536))) == "1.5 KB" and one(spark, T.human_bytes(F.lit(10))) == "10 B"
    assert one(spark, edits.format_like(F.lit("১০%"), F.lit(25.0))) == "২৫%"
    assert one(spark, T.digit_script(F.lit("১"))) == "bn"
    assert one(spark, T.clean_output(F.lit('```text\n"Hello."\n```'))) == "Hello."
    assert one(spark, T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_intended_change(spark):
    f = lambda x, y, t, r: one(spark, verify.intended_change(F.lit(x), F.lit(y), F.lit("numerical_fact"), F.lit(t), F.lit(r), BANGLA)["reason"])
    assert f("সুদ ১০ শতাংশ।", "সুদ ১০০ শতাংশ।", "১০ শতাংশ", "১০০ শতাংশ") == "passed"
    assert f("সুদ ১০ শতাংশ।", "সুদ ১১ শতাংশ।", "১০ শতাংশ", "১১ শতাংশ") == "numeric_scale_change_too_weak"
    assert f("সুদ ১০।", "সুদ ১০।", "১০", "১০") == "target_unchanged"


def test_plans_and_edits(spark):
    text = "The bank said rates rose 10 percent. It was quiet. The bank said so."
    rows = spark.createDataFrame([("a", "Rates", text, 0, "numerical_fact", "10", "95"), ("b", "bank", text, 0, "entity_replacement", "bank", "board"), ("c", "x", text, 7, "numerical_fact", "10", "95")], "article_id string, headline string, text string, idx int, family string, target_span string, replacement string")
    got = {r.article_id: r for r in edits.apply_plan(rows, LATIN).collect()}
    assert got["a"].rewritten == text.replace("10", "95") and got["b"].rewritten == text.replace("bank", "board") and got["b"].rewritten_headline == "board"
    assert got["c"].edit_error == "sentence_missing" and got["c"].rewritten is None
    answer = rows.withColumn("answer", F.lit("The bank said rates rose 95 percent"))
    assert {r.localize_error for r in edits.localize(answer.filter("idx = 0 AND article_id = 'a'"), "answer", LATIN).collect()} == {None}


def test_pipeline_end_to_end(spark, tmp_path):
    text = "Lending with thation rose by 10 items this ction. It stayed calm. Nothing else."
    rows = spark.createDataFrame([("a", "Lending news", text), ("b", "none", "Hm.")], "article_id string, headline string, text string")
    planner = lambda c: edits.heuristic_plan(c).withColumn("replacement", F.lit("900"))
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    samples, failures = pipeline.run(rows, LATIN, planner)
    got = samples.collect()
    assert [r.article_id for r in got] == ["a"] and "900 items" in got[0].rewritten and got[0].label == 1 and got[0].original_id == "a"
    assert {r.article_id: r.reason for r in failures.collect()} == {"b": "no_claim"}
    sinks.write_csv(samples, str(tmp_path / "csv"))
    assert readers.csv(spark, str(tmp_path / "csv")).count() == 1
    assert set(sinks.workbook_sheets(samples)) == set(sinks.WORKBOOK_SHEETS)


def test_greedy_accept_is_the_sequential_rule(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (2, 5), (6, 7), (4, 7)]
    frame = spark.createDataFrame([(a, b, 0.9) for a, b in pairs], "left_id long, right_id long, similarity double")
    ids = spark.createDataFrame([(i,) for i in range(1, 9)], "vec_id long")
    want, taken = {}, set()
    for i in range(1, 9):
        want[i] = not any(a in taken for a, b in pairs if b == i)
        if want[i]:
            taken.add(i)
    assert {r.vec_id: r.accepted for r in dedup.greedy_accept(frame, ids, settle=lambda df: df).collect()} == want


@pytest.mark.parametrize("block", [100, 10_000])
def test_similar_pairs_in_blocks(spark, block):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").limit(300)
    got = {(r.left_id, r.right_id) for r in dedup.similar_pairs(rows, 0.3, block=block).collect()}
    v = {r.vec_id: r.embedding for r in rows.collect()}
    norm = {k: math.sqrt(sum(x * x for x in a)) for k, a in v.items()}
    assert got == {(a, b) for a in v for b in v if a < b and sum(x * y for x, y in zip(v[a], v[b], strict=True)) / norm[a] / norm[b] >= 0.3}


def test_splits(spark):
    rows = spark.createDataFrame([(f"g{i % 17}", i) for i in range(200)], "g string, i int")
    for split in (dataset.grouped_split(rows, "g"), dataset.hash_split(rows, "g")):
        assert split.count() == 200 and not dataset.leakage(split, "g").first().has_leakage
    shares = {r.split: r.n for r in reports.distribution(dataset.grouped_split(rows, "g"), "split").collect()}
    assert shares["train"] > shares["test"]
    leaky = rows.withColumn("split", F.when(F.col("i") == 0, "test").otherwise("train"))
    with pytest.raises(ValueError):
        dataset.require_no_leakage(leaky, "g")


def test_results_do_not_depend_on_partitions(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source")
    a = dataset.grouped_split(rows, "source").collect()
    b = dataset.grouped_split(rows.repartition(7), "source").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('article_id,headline,text,extra\n1,h,"two\nlines ""q""",x\n2,h,  ,y\n3,h,third,z\n')
    got = readers.articles(spark, str(tmp_path / "a.csv")).orderBy("article_id").collect()
    assert [(r.article_id, r.text) for r in got] == [("1", 'two\nlines "q"'), ("3", "third")] and got[0].metadata == {"article_id": "1", "extra": "x"}
    assert [r.article_id for r in readers.articles(spark, str(tmp_path / "a.csv"), offset=1).collect()] == ["3"]
    (tmp_path / "b.jsonl").write_text('{"id":"a","n":1}\nnot json\n{"id":"a","n":2}\n{"id":"b","n":3}\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "b.jsonl"), "id string, n int", "id")
    assert sorted(map(tuple, good.collect())) == [("a", 2), ("b", 3)] and [r.value for r in bad.collect()] == ["not json"]
    (tmp_path / "log").write_text("GPU 10 MB\nx\nGPU 30 MB\nGPU 20 MB\n")
    assert tuple(readers.log_metrics(spark.read.text(str(tmp_path / "log")), {"gpu": "GPU ([0-9]+) MB"}).first()) == (30.0, 20.0)
    assert readers.count_lines(spark, str(tmp_path / "log")) == 4
    assert readers.terms(spark, str(tmp_path / "none.csv"), "term").count() == 0


def test_model_answers(spark):
    rows = spark.createDataFrame([("a", 'Sure:\n```json\n[{"claim": "x", "type": "ENTITY", "index": 2, "confidence": 3}, {"type": "other"}]\n```'), ("b", "no json")], "id string, answer string")
    parsed = rows.withColumn("json", adapters.json_payload("answer")).drop("answer")
    got = claims.normalize_rows(parsed, "json").collect()
    assert [(r.id, r.rejected) for r in got] == [("a", False), ("a", True), ("b", True)]
    assert got[0].claim.claim_type == "entity" and got[0].claim.confidence == 1.0 and got[0].claim.idx == 2
    assert [(m["start"], m["term"]) for m in one(spark, adapters.longest_mentions(F.lit("ab abc"), F.array(F.lit("ab"), F.lit("abc"))))] == [(0, "ab"), (3, "abc")]


def test_config():
    c = {"a": {"b": 2, "c": "x${a.b}", "d": "${a.b}", "e": "${no.such}"}}
    assert config.resolve(c)["a"] == {"b": 2, "c": "x2", "d": 2, "e": "${no.such}"}
    assert config.override(c, {"a.b": 5})["a"]["b"] == 5
    with pytest.raises(KeyError):
        config.override(c, {"a.z": 1})


def test_resume_and_stream(spark, tmp_path):
    log, source = str(tmp_path / "log"), str(tmp_path / "in")
    stage = lambda df: df.withColumn("n", F.length("text"))
    rows = spark.createDataFrame([("a", "x"), ("b", "yy")], "id string, text string")
    incremental.process(rows.limit(1), stage, log, "id")
    assert incremental.process(rows, stage, log, "id").count() == 2
    rows.union(spark.createDataFrame([("c", "z")], "id string, text string")).write.parquet(source)
    q = incremental.stream(spark, source, "id string, text string", stage, log, str(tmp_path / "ck"), "id")
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(log).collect()) == ["a", "b", "c"]


def test_generation_failure_is_one_row_s(spark):
    def factory():
        def run(prompts, temperatures, seeds):
            if "bad" in prompts:
                raise RuntimeError("no")
            return [p.upper() for p in prompts]

        return run

    rows = spark.createDataFrame([("ok",), ("bad",), ("fine",)], "p string").coalesce(1)
    got = rows.select("p", adapters.generate(factory, F.col("p"), F.lit(0.1), F.lit(1)).alias("t")).collect()
    assert {r.p: r.t for r in got} == {"ok": "OK", "bad": None, "fine": "FINE"}
