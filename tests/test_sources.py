"""Readers, lineage, manifests, knowledge files, reports and cached vectors on real files."""

import csv
import gzip
import hashlib
import json
import random
from contextlib import contextmanager

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskgraph.functions.text import RISK_PHRASES, SPAN_CHUNK, phrase_spans, signed_hash_dense
from riskgraph.operators import memory as V
from riskgraph.operators.audit import AuditError
from riskgraph.operators.knowledge import read_entities
from riskgraph.plans import reporting
from riskgraph.sources import files, recalls, tables


def line(**values):
    return "\t".join(values.get(f, "") for f in recalls.FIELDS)


def test_raw_lines_keep_bytes_offsets_and_encodings(spark, tmp_path):
    raw = [
        line(RECORD_ID="1", CAMPNO="C", RCDATE="20180101", NOTES="plain").encode() + b"\r\n",
        line(RECORD_ID="2", CAMPNO="C", RCDATE="20190101").encode() + b"\x93quoted\x94\n",
        line(RECORD_ID="3", RCDATE="20180230").encode() + b"\n",
        b"a\tb\n",
        line(RECORD_ID="5", CAMPNO="D", RCDATE="20200101").encode() + b"\x81",
    ]
    (tmp_path / "flat.txt").write_bytes(b"".join(raw))
    lines = recalls.read_raw_lines(spark, str(tmp_path / "flat.txt")).cache()
    offset = 0
    for want, got in zip(raw, lines.orderBy("byte_offset").collect()):
        assert (got.byte_offset, got.line_bytes, got.line_sha256) == (offset, len(want), hashlib.sha256(want).hexdigest())
        offset += len(want)
    split = recalls.split_fields(lines)
    assert [r.encoding for r in split.orderBy("line_number").collect()] == ["utf-8", "cp1252", "utf-8", "utf-8", "iso8859-1"]
    kept = recalls.accepted_rows(split).orderBy("line_number").collect()
    assert [r.RECORD_ID for r in kept] == ["1", "2", "5"] and kept[1].PARK_OUTSIDE == "“quoted”" and kept[0].PARK_OUTSIDE == ""
    assert rows(recalls.rejected_rows(split).select("line_number", "reason")) == [
        (3, "invalid_or_missing_report_received_date"), (4, "field_count_not_29")]
    stored = lines.withColumn("line_sha256", F.when(F.col("line_number") == 2, "x").otherwise(F.col("line_sha256")))
    assert [r.problem for r in recalls.reread_lines(lines, stored).collect()] == ["hash_differs"]


def test_offsets_across_many_splits(spark, tmp_path):
    raw = [(f"row {i} " + "x" * (i % 50)).encode() + b"\n" for i in range(2000)]
    (tmp_path / "big.txt").write_bytes(b"".join(raw))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = recalls.read_raw_lines(spark, str(tmp_path / "big.txt")).orderBy("line_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    offset = 0
    for i, (want, r) in enumerate(zip(raw, got)):
        assert (r.line_number, r.byte_offset, r.line_bytes) == (i + 1, offset, len(want))
        offset += len(want)
    assert len(got) == 2000


def test_jsonl_rejects(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": \n[1]\n{"k": 2}\n')
    good, bad = tables.read_jsonl_audited(spark, str(tmp_path / "a.jsonl"), "k int")
    assert rows(good) == [(1,), (2,)] and rows(bad.select("code")) == [("jsonl_blank_line",), ("jsonl_parse",), ("jsonl_record",)]


@contextmanager
def split_bytes(spark, n):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_strict_csv(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text('\ufeffid,"label", note\r\n a ,1,"x, y"\r\n\r\n,,\r\nb,0,\r\n', encoding="utf-8", newline="")
    got = tables.read_strict_csv(spark, str(path), ["id", "label"], ["more"])
    assert rows(got.drop("csv_file")) == [("a", "1", "x, y", "", 2), ("b", "0", "", "", 4)]
    for text in ("id,id\n1,2\n", "id\n1\n", "id,label\n1,2,3\n", "id,label\n1\n", "", "\n\n", 'id,label\n1,"2\n'):
        path.write_text(text)
        with pytest.raises((AuditError, PySparkException)):
            tables.read_strict_csv(spark, str(path), ["id", "label"]).count()
    path.write_text("id\n\n1\n \n2")
    assert rows(tables.read_strict_csv(spark, str(path), ["id"]).drop("csv_file")) == [("1", 2), ("2", 4)]


def test_strict_csv_over_many_splits_equals_the_csv_module(spark, tmp_path):
    pick = random.Random(5)
    cells = ["a", "", " b ", "x,y", 'say "hi"', '"', "two\nlines", "\n\n", 'q"\n,"\nr', "é" * 40, "l\r\nm", "z" * 300, "\u2028u"]
    for name, n in (("one.csv", 700), ("two.csv", 300)):
        with open(tmp_path / name, "w", newline="", encoding="utf-8-sig" if n == 700 else "utf-8") as out:
            writer = csv.writer(out, lineterminator="\n" if n == 700 else "\r\n")
            writer.writerow(["id", "note\nlong", "rest"])
            for i in range(n):
                writer.writerow([i, pick.choice(cells), pick.choice(cells)])
                out.write(pick.choice(["", "", "\n", 'lit"eral,mid"dle "x,y"z\n']))
            writer.writerow([n, "across\n" * 400, ""])
    want = []
    for name in ("one.csv", "two.csv"):
        with open(tmp_path / name, newline="", encoding="utf-8-sig") as lines:
            records = [r for r in csv.reader(lines) if r]
        want += [(*[v.strip() for v in r], name, i + 1) for i, r in enumerate(records) if i and any(v.strip() for v in r)]
    for size in (1000, 1 << 27):
        with split_bytes(spark, size):
            got = tables.read_strict_csv(spark, str(tmp_path), ["id", "note\nlong", "rest"]).withColumn("csv_file", F.element_at(F.split("csv_file", "/"), -1)).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_hashes_of_files_of_any_shape(spark, tmp_path):
    pick = random.Random(2)
    bodies = {"empty": b"", "break": b"\n", "breaks": b"\n\n\n", "open": b"a\nb", "closed": b"a\nb\n", "bytes": bytes(pick.randrange(256) for _ in range(300_000)), "cr": b"x\r\ny\r", "b.gz": gzip.compress(b"a\n" * 50)}
    (tmp_path / "deep").mkdir()
    for name, body in bodies.items():
        (tmp_path / ("deep" if len(name) > 4 else ".") / name).write_bytes(body)
    with split_bytes(spark, 1000):  # far below the size of a file, which is one unit nevertheless
        got = {r.path: (r.bytes, r.sha256) for r in files.file_hashes(spark, str(tmp_path)).collect()}
    assert got == {("deep/" if len(n) > 4 else "") + n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in bodies.items()}


def test_rows_against_the_bytes_they_came_from(spark, tmp_path):
    raw = [line(RECORD_ID=str(i), CAMPNO=f"C{i}", RCDATE="20190101", NOTES="é").encode("utf-8" if i % 2 else "cp1252") for i in range(8)]
    (tmp_path / "flat.txt").write_bytes(b"\n".join(raw) + b"\n")
    lines = recalls.read_raw_lines(spark, str(tmp_path / "flat.txt")).cache()
    stored = recalls.accepted_rows(recalls.split_fields(lines))
    assert recalls.recheck_rows(lines, stored).count() == 0
    n, hit = F.col("RECORD_ID"), lambda k, new, c: F.when(F.col("RECORD_ID") == k, new).otherwise(F.col(c)).alias(c)
    bent = stored.select(
        *[c for c in stored.columns if c not in ("NOTES", "MAKETXT", "encoding", "line_sha256", "byte_offset")], hit("1", F.lit("e"), "NOTES"), hit("1", F.lit(None), "MAKETXT"),
        hit("2", F.lit("utf-8"), "encoding"), hit("3", F.lit("0"), "line_sha256"), F.when(n == "4", F.col("byte_offset") + 1).otherwise(F.col("byte_offset")).alias("byte_offset"),
    )
    at = {i: sum(len(r) + 1 for r in raw[:i]) + (i == 4) for i in range(8)}
    assert rows(recalls.recheck_rows(lines, bent).drop("file")) == sorted(
        [(at[1], "fields_differ", "MAKETXT NOTES"), (at[2], "fields_differ", ""), (at[3], "hash_differs", None), (at[4], "no_line_at_offset", None)], key=repr)


def test_lines_move_to_their_rows_as_bytes(spark, tmp_path):
    raw = [line(RECORD_ID=str(i), RCDATE="20190101", NOTES="é").encode("cp1252" if i else "utf-8") for i in range(3)]
    (tmp_path / "flat.txt").write_bytes(b"\n".join(raw))  # the last line has no line break
    lines = recalls.read_raw_lines(spark, str(tmp_path / "flat.txt"))
    stored = recalls.accepted_rows(recalls.split_fields(lines)).localCheckpoint()
    assert stored.count() == 3 and recalls.recheck_rows(lines, stored).count() == 0
    (tmp_path / "flat.txt").write_bytes(b"\n".join([raw[0], raw[1].replace(b"1", b"7", 1), raw[2]]) + b"\n")
    now = recalls.recheck_rows(recalls.read_raw_lines(spark, str(tmp_path / "flat.txt")), stored)
    assert rows(now.select("byte_offset", "problem", "fields")) == [(len(raw[0]) + 1, "hash_differs", None), (len(raw[0]) + len(raw[1]) + 2, "length_differs", None)]
    moved = now._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1]
    assert "sha2(" not in moved and "split(" not in moved


def test_each_file_has_a_task_of_its_own(spark):
    from riskgraph.catalog.sources import FILES, _in_files

    placed = _in_files(spark.range(320), F.col("id"), ["id"]).withColumn("task", F.spark_partition_id())
    got = {(r.part, r.task): r.n for r in placed.groupBy("part", "task").agg(F.count("*").alias("n")).collect()}
    assert got == {(p, p): 320 // FILES for p in range(FILES)}


def test_publish_refuses_violations_and_existing_output(spark, tmp_path):
    df, out = spark.range(3), str(tmp_path / "t")
    with pytest.raises(AuditError):
        tables.publish(df, out, {"must be empty": df})
    assert not (tmp_path / "t").exists()
    tables.publish(df, out, {"must be empty": df.filter("id > 5")})
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tables.publish(df, out)


def test_paged_results(spark):
    page = lambda n: [("p1", n, [("a",), ("b",)])]
    schema = "file string, Count int, Results array<struct<name:string>>"
    assert tables.paged_results(spark.createDataFrame(page(2), schema)).count() == 2
    with pytest.raises(Exception, match="count mismatch"):
        tables.paged_results(spark.createDataFrame(page(3), schema)).collect()


def test_manifest(spark, tmp_path):
    for name in ("same", "changed", "extra"):
        (tmp_path / name).write_text(name)
    digest = hashlib.sha256(b"same").hexdigest()
    manifest = spark.createDataFrame(
        [("same", 4, digest), ("changed", 7, digest), ("gone", 1, digest), ("../up", 1, digest), ("same2", 1, digest), ("same2", 1, digest)],
        "path string, bytes bigint, sha256 string")
    got = dict(rows(files.compare_manifest(manifest, files.file_hashes(spark, str(tmp_path)))))
    assert got == {"changed": "changed", "extra": "unlisted", "gone": "missing", "../up": "path_escape", "same2": "listed_twice"}


def test_knowledge_files_need_their_sidecar(spark, tmp_path):
    def save(name, entities, status=200, digest=None, **more):
        body = json.dumps({"entities": entities, **more}).encode() if entities is not None else b"{"
        (tmp_path / f"{name}.json").write_bytes(body)
        meta = {"status": status, "sha256": digest or hashlib.sha256(body).hexdigest()}
        (tmp_path / f"{name}.provenance.json").write_text(json.dumps(meta))

    save("seed_0000", {"Q1": {"v": 1}, "Q2": {"missing": ""}, "P5": {}}, error=None)
    save("seed_0001", {"Q1": {"v": 2}, "Q7": {"v": 1}})
    save("seed_0002", {"Q3": {}}, status=500)
    save("seed_0003", {"Q4": {}}, digest="bad")
    save("seed_0004", {"Q5": {}}, error={"code": "x"})
    save("seed_0005", None)
    save("seed_0006.attempt1", {"Q6": {}})
    (tmp_path / "seed_0007.json").write_text("{}")
    save("other_0000", {"Q9": {}})
    save("early_0000", {"Q7": {"v": 9}})
    accepted, refused = read_entities(spark, str(tmp_path), ["seed_", "early_"])
    assert sorted((r.qid, json.loads(r.record)["v"], r.file) for r in accepted.collect()) == [("Q1", 2, "seed_0001"), ("Q7", 9, "early_0000")]
    assert rows(refused) == [("seed_0002", "status"), ("seed_0003", "hash"), ("seed_0004", "error"), ("seed_0005", "not_json"), ("seed_0007", "no_sidecar")]
    accepted, _ = read_entities(spark, str(tmp_path), ["early_", "seed_"])
    assert {r.qid: r.file for r in accepted.collect()}["Q7"] == "seed_0001"


def run(root, name, mode, seed, auprc, digest="h", status="completed"):
    folder = root / name
    folder.mkdir(parents=True)
    (folder / "result.json").write_text(json.dumps({
        "status": status, "dataset": "A", "mode": mode, "seed": seed, "config": {"dataset_sha256": digest}, "runtime_seconds": 1.5,
        "test": {"node": {"auprc": auprc}, "path": {"path_f1": None}} if status == "completed" else None}, indent=1))


def test_report_from_result_tree(spark, tmp_path):
    run(tmp_path, "r1", "full", 1, 0.2)
    run(tmp_path, "r2", "full", 2, 0.4)
    run(tmp_path, "deep/r3", "text", 1, 0.1)
    run(tmp_path, "r4", "text", 2, None, status="failed")
    done, failed = reporting.collect_runs(spark, str(tmp_path))
    out = reporting.report(done)
    shown = {(r["mode"], r["metric"]): r["shown"] for r in out["summary"].collect()}
    assert shown["full", "node.auprc"] == "0.3000 ± 0.1414" and shown["text", "node.auprc"] == "0.1000 (n=1)"
    assert shown["full", "path.path_f1"] == "NA" and failed.count() == 1
    reporting.write_report(out, str(tmp_path / "out"))
    assert list((tmp_path / "out" / "paired").glob("*.csv"))
    run(tmp_path, "r5", "full", 1, 0.9)
    with pytest.raises(AuditError, match="repeated"):
        reporting.collect_runs(spark, str(tmp_path))


def test_cached_vectors(spark):
    cache = spark.createDataFrame([("shared evidence", [0.2, 0.8]), ("other evidence", [-0.6, 0.5])], "text string, embedding array<double>")
    signals = spark.createDataFrame([(10, "a", "shared evidence"), (20, "b", "shared evidence"), (30, "a", "other evidence")], "signal_id int, entity_id string, text string")
    vectors = V.vectors_by_text(signals, cache)
    assert {r.signal_id: r.embedding for r in vectors.collect()} == {10: [0.2, 0.8], 20: [0.2, 0.8], 30: [-0.6, 0.5]}
    for text in ("not cached", None):
        unknown = signals.withColumn("text", F.lit(text).cast("string"))
        with pytest.raises(Exception, match="missing from cache"):
            V.vectors_by_text(unknown, cache).select("signal_id").collect()
        assert V.vectors_by_text(unknown, cache, strict=False).count() == 0
    memory = spark.createDataFrame([(0, "a", 0, 10), (0, "a", 1, 99)], "snapshot int, node_id string, slot int, signal_id int")
    with pytest.raises(Exception, match="unknown signal"):
        V.gather_vectors(memory, vectors).select("slot").collect()
    assert [r.slot for r in V.gather_vectors(memory, vectors, strict=False).collect()] == [0]


def test_pooled_signals_equal_pooled_slots(spark):
    pick = random.Random(2)
    slots = [(s, n, k, pick.randrange(6)) for s in range(4) for n in range(3) for k in range(pick.randrange(5))]
    memory = spark.createDataFrame([*slots, (9, 1, 0, 3), (9, 1, 1, 3), (9, 1, 2, 4)], "snapshot int, node_id int, slot int, signal_id int")
    vectors = spark.createDataFrame([(i, [float(i), None if i == 4 else 1.0]) for i in range(6)], "signal_id int, vector array<float>")
    keys = ["snapshot", "node_id"]
    pooled = V.pool_signals(memory, vectors, dim=2)
    want = V.mean_pool(V.gather_vectors(memory, vectors), keys, dim=2)
    got = {r[:2]: r.pooled for r in pooled.select(*keys, "pooled").collect()}
    assert got[(9, 1)] == [pytest.approx(10 / 3), 1.0]
    assert got.keys() == {r[:2] for r in want.collect()}
    for r in want.collect():
        assert got[r[:2]] == pytest.approx(r.pooled)
    for df in (pooled, want):  # no sums and counts of components move: both steps of the means lie in one stage
        planned = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
        at = next(i for i, x in enumerate(planned) if "partial_avg" in x)
        assert "Exchange" not in planned[at - 1] and "Aggregate" in planned[at - 1]
    with pytest.raises(Exception, match="unknown signal"):
        V.pool_signals(memory.withColumn("signal_id", F.lit(99)), vectors, dim=2).collect()
    assert V.pool_signals(memory.withColumn("signal_id", F.lit(99)), vectors, dim=2, strict=False).count() == 0


def test_future_evidence_is_rejected(spark):
    slots = spark.createDataFrame([(0, "a", 0, -1, 0.5, 1.0)], "snapshot int, node_id string, slot int, age_days int, confidence double, score double")
    with pytest.raises(Exception, match="future evidence"):
        V.attention_weights(slots).collect()


def test_text_features(spark):
    texts = ["Chip shortage, CHIP shortage! 停产 x_1", "", "naïve Ünïcode 世界 ２"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    import re

    for r in signed_hash_dense(df, "id", "text").collect():
        want = [0.0] * 64
        for token in re.findall(r"\w+", texts[r.id].lower()):
            digest = hashlib.sha256(token.encode()).digest()
            want[int.from_bytes(digest[:4], "little") % 64] += 1 if digest[4] & 1 else -1
        size = max(sum(x * x for x in want) ** 0.5, 1.0)
        assert list(r.vector) == pytest.approx([x / size for x in want])
    spans = phrase_spans(df, "text", RISK_PHRASES).collect()
    assert sorted((r.phrase, r.span_start, r.span_end) for r in spans) == [("CHIP shortage", 15, 28), ("Chip shortage", 0, 13), ("停产", 30, 32)]


def test_hash_vectors_keep_repeated_keys_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "alpha alpha"), (1, "beta"), (2, None), (3, "")], "id int, text string")
    got = signed_hash_dense(df, "id", "text").collect()
    sizes = sorted((r.id, round(sum(v * v for v in r.vector), 9)) for r in got)
    assert sizes == [(1, 1.0), (1, 1.0), (2, 0.0), (3, 0.0)] and all(len(r.vector) == 64 for r in got)


def test_spans_of_very_many_matches(spark):
    import re

    texts = ["é停产-STRIKE, " * 300, "strike" * SPAN_CHUNK, "strike" * (SPAN_CHUNK + 1), "none", "", None]
    phrases = ["停产", "strike", "strike zone"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted((r.id, r.span_start, r.span_end, r.phrase) for r in phrase_spans(df, "text", phrases).collect())
    assert got == sorted((i, m.start(), m.end(), m.group()) for i, t in enumerate(texts) if t for m in re.finditer("停产|strike", t, re.I))
    long = spark.range(1).selectExpr("repeat('a strike ', 100000) AS text")
    last = phrase_spans(long, "text", phrases).agg(F.count("*").alias("n"), F.max("span_end").alias("end")).first()
    assert (last.n, last.end) == (100_000, 899_999)


def test_a_row_that_names_one_utility_twice(spark):
    from riskgraph.operators import survey as S

    rows_ = spark.createDataFrame(
        [(2001, 5, "7.0", "Reporter", "3", "G1", "7", "Owner", "40", "x"), (2000, 9, None, "Nobody", "3", "G1", "7", "Older", "1", "x")],
        ["year", "row", "Utility ID", "Utility Name", "Plant Code", "Generator ID", "Ownership ID", "Owner Name", "Percent Owned", "Footnote"])
    kept = S.project_fields(rows_, "ownership", at=["year", "row"])
    assert kept.columns == ["year", "row", "Utility ID", "Utility Name", "Plant Code", "Generator ID", "Owner Name", "Ownership ID", "Percent Owned"]
    entities, relations = S.asset_graph({"ownership": kept})
    assert {(r.entity_id, r.name) for r in entities.collect()} == {("eia:utility:7", "Reporter"), ("eia:plant:3", None), ("eia:generator:3:G1", "G1")}
    owned = relations.filter("relation_type = 'OwnsReportedGenerator'").first()
    assert (owned["head"], owned["tail"], owned["observed_attributes"]) == ("eia:utility:7", "eia:generator:3:G1", {"2001": "40"})


def moves(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_field_variants_move_a_row_once(spark):
    from riskgraph.operators.facts import field_variants

    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("a", "y", None), ("b", "x", 2), (None, "x", 1), (None, "y", 2)], "k string, f string, g int")
    got = field_variants(df, ["k"], ["f", "g"])
    assert moves(got) == 1
    assert sorted(map(tuple, got.select("k", "field", "value", "n_values").collect())) == [("a", "f", "x", 2), ("a", "f", "y", 2)]


def test_fact_edges_and_relations_move_a_record_once(spark):
    from riskgraph.operators.facts import fact_edges
    from riskgraph.operators.survey import upsert_relations

    support = spark.createDataFrame([("s", "r", "t", "c1", 3), ("s", "r", "t", "c1", 1), ("s", "r", "t", "c2", 2), ("s", "r", "u", None, 9)], "source string, relation string, target string, campaign_id string, line_number int")
    got = fact_edges(support)
    assert moves(got) == 1
    assert sorted(map(tuple, got.select("target", "n_records", "n_members", "line_number").collect())) == [("t", 3, 2, 1), ("u", 1, 0, 9)]
    seen = spark.createDataFrame([("h", "t", "R", 2001, 1, None), ("h", "t", "R", 2001, 2, "a"), ("h", "t", "R", 2002, 3, "b")], "head string, tail string, relation_type string, year int, row int, attribute string")
    got = upsert_relations(seen, ["year", "row"], "year", "attribute")
    assert moves(got) == 1
    r = got.first()
    assert (r.first_year, r.last_year, r.n_observed, r.observed_attributes) == (2001, 2002, 3, {"2001": "a", "2002": "b"})


def test_table_differences_move_digests_once(spark):
    from riskgraph.operators.audit import table_differences

    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z"), (4, "w"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (2, ""), (3, "z"), (5, "w"), (None, "n")], "k int, v string")
    got = table_differences(a, b, ["k"], ["v"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
    assert sorted(map(tuple, got.collect())) == [(1, 2, 2, "different"), (2, 1, 1, "different"), (4, 1, 0, "missing"), (5, 0, 1, "extra")]


def rows_moved(df):
    """Rows that the exchanges of a collected frame wrote."""
    df.collect()
    nodes, moved = [df._jdf.queryExecution().executedPlan().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        nodes += [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        moved += node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    return moved


def test_table_differences_move_rows_of_unlike_records_only(spark):
    from riskgraph.operators.audit import table_differences

    long = spark.range(400).select((F.col("id") / 4).cast("int").cast("string").alias("k"), (F.col("id") % 4).alias("m"), F.lit("x").alias("v"))
    long = long.unionByName(long.filter("k = '7'"))
    other = long.withColumn("v", F.when((F.col("k") == "7") & (F.col("m") == 2), "y").otherwise(F.col("v")))
    for marks, rows in ((1, 808), (1 << 28, 16)):
        got = table_differences(long, other, ["k", "m"], ["v"], ranges=1, together=["k"], marks=marks)
        assert rows_moved(got) == rows
        assert list(map(tuple, got.collect())) == [("7", 2, 2, 2, "different")]


@pytest.mark.parametrize("together", [None, ["k"], ["m"]])
def test_table_differences_whatever_shares_a_bit(spark, together):
    from riskgraph.operators.audit import table_differences

    shape = "k string, m int, v double"
    a = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 1.0), ("a", 2, None), (None, 1, 3.0), (None, 1, 3.0), ("c", None, 4.0), ("d", 1, 5.0), ("d", 2, 6.0)], shape)
    b = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 0.0), (None, 1, 3.0), ("c", None, 4.0), ("d", 2, 5.0), ("d", 1, 6.0), (None, None, None)], shape)
    want = {("a", 1, 2, 2, "different"), ("a", 2, 1, 1, "different"), (None, 1, 2, 1, "repeated"), ("d", 1, 1, 1, "different"), ("d", 2, 1, 1, "different"), (None, None, 0, 1, "extra")}
    for marks in (1, 100, 1 << 28):
        assert {tuple(r) for r in table_differences(a, b, ["k", "m"], ["v"], 3, together, marks).collect()} == want
    assert table_differences(a, a.orderBy("v"), ["k", "m"], ["v"], 3, together).isEmpty()



def test_support_is_written_without_what_other_values_give(spark, monkeypatch):
    from riskgraph.catalog import facts
    from riskgraph.operators.facts import fact_edge_support

    written = []
    monkeypatch.setattr(facts, "durable", lambda df, label: written.append(df.columns) or df)
    d = "/root/testdata/sf0.001"
    got = facts.edge_support(spark, d)
    assert written == [["record_id", "campaign_id", "POTAFF", "reporter", "listed", "product", "component_id"]]
    assert rows(got) == rows(fact_edge_support(facts.parts(spark, d), ["first_record"]))
