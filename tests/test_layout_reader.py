"""Reader of parser output, artifacts of the newest run, and reports per case."""

import json

from pagewright import settings as S
from pagewright.operators import evaluation as E
from pagewright.operators import lifecycle as Y
from pagewright.operators import summary as U
from pagewright.plans import layout_queries
from pagewright.sources import files as I

BLOCK = {"bbox": [700, 5, 10.004, 20], "text": "a", "block_index": 0, "lines": [{"bbox": [0, 0, 1, 1], "text": "a", "line_index": 0}]}
PAGE = {"document_id": 1, "page_number": 2, "width": 612, "height": 792, "rotation": 450, "raw_text": "a", "blocks": [BLOCK],
        "words": [{"bbox": [1, 2, 3, 4], "text": "a", "block_index": 0, "line_index": 0, "word_index": 0}],
        "tables": [{"bbox": [1, 2, 3, 4], "row_count": 1, "column_count": 2, "cells": [["x", None]], "markdown": "|x||", "status": "extracted", "confidence": 0.5}],
        "image_bboxes": [[0, 0, 9999, 9999]]}


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_a_page_becomes_rows_of_every_table(spark):
    out = I.parse_layout(lines(spark, json.dumps(PAGE), "", None, "  "))
    assert [tuple(r) for r in out.pages.collect()] == [(1, 0, 2, 612.0, 792.0, 90, "a")]
    block = out.blocks.first()
    # clipped to the page, corners in order, two decimals
    assert (block.x0, block.y0, block.x1, block.y1) == (10.0, 5.0, 612.0, 20.0)
    assert (block.block_type, block.source_method) == ("text", "digital")
    assert out.lines.first().text == "a" and out.words.first().word_index == 0
    assert out.tables.first().cells == [["x", None]] and out.tables.first().table_index == 0
    assert (out.images.first().x1, out.images.first().y1) == (612.0, 792.0)
    assert out.rejected.count() == 0


def test_faults_are_kept_apart_with_their_line(spark):
    def but(**changed):
        return json.dumps(PAGE | changed)

    cases = {
        '{"document_id": 1, "page': "malformed", "[1]": "malformed", but(width="wide"): "malformed", but(document_id=None): "no_page", but(page_number=0): "no_page",
        "{}": "no_page", but(height=0): "bad_size", but(width=None): "bad_size", but(image_bboxes=[None]): "bad_box", but(image_bboxes=[[1, 2, 3]]): "bad_box",
        but(words=[{"bbox": [1, 2, None, 4], "text": "a"}]): "bad_box", but(blocks=[BLOCK | {"lines": [{"bbox": []}]}]): "bad_box",
        but(blocks=[BLOCK, BLOCK]): "bad_block", but(blocks=[BLOCK | {"text": None}]): "bad_block", but(blocks=[BLOCK | {"block_index": None}]): "bad_block",
    }
    out = I.parse_layout(lines(spark, *cases))
    assert {r.line: r.reason for r in out.rejected.collect()} == cases
    assert out.pages.count() == out.blocks.count() == out.images.count() == 0


def test_missing_parts_empty_files_and_clashing_columns(spark, tmp_path):
    bare = {"document_id": 7, "page_number": 1, "width": 1, "height": 1}
    rows = spark.createDataFrame([(json.dumps(bare), "x", 5), (json.dumps(bare), "y", 6)], "value string, extra string, document_id int")
    out = I.parse_layout(rows)
    # a page that is there twice stays twice
    assert [tuple(r) for r in out.pages.collect()] == [(7, 0, 1, 1.0, 1.0, 0, "")] * 2
    assert [t.count() for t in out[1:]] == [0] * 6
    (tmp_path / "none.jsonl").write_text("")
    assert [t.count() for t in I.read_layout(spark, str(tmp_path))] == [0] * 7


def test_no_table_of_the_reader_is_shuffled(spark):
    for table in I.parse_layout(lines(spark, json.dumps(PAGE))):
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()


def test_artifacts_of_the_newest_successful_run(spark):
    runs = spark.createDataFrame(
        [(1, 10, 1, "succeeded", 1), (2, 10, 2, "succeeded", 2), (3, 10, 2, "succeeded", 1), (4, 10, 3, "failed", 2), (5, 11, 1, "succeeded", None), (6, 12, 1, "failed", 1), (7, 13, 1, "succeeded", 1)],
        "run_id long, document_id long, created_at long, status string, source_revision long")
    artifacts = spark.createDataFrame([(r, d, p) for r, d in ((1, 10), (2, 10), (3, 10), (4, 10), (5, 11), (6, 12)) for p in (0, 1)], "run_id long, document_id long, position long")
    documents = spark.createDataFrame([(10, 2), (11, 1), (12, 1), (13, 1)], "document_id long, content_revision long")
    got = sorted((r.document_id, r.run_id, r.position, r.stale) for r in U.latest_artifacts(runs, artifacts, documents).collect())
    # of two runs of one time the larger id counts; a revision that isn't known is not stale; older runs don't stand in
    assert got == [(10, 3, 0, True), (10, 3, 1, True), (11, 5, 0, False), (11, 5, 1, False)]
    assert U.latest_artifacts(runs.limit(0), artifacts, documents).count() == 0


def test_a_case_report_holds_its_runs_in_order(spark):
    names = ["case_id", "category", "safety_critical", "run_index", "status", "claim_count", "citation_count", "latency", "passed", "explicit", "critical", "failure_category", "provider_error"]
    kinds = "case_id long, category string, safety_critical boolean, run_index long, status string, claim_count long, citation_count long, latency double, passed boolean, explicit boolean, " \
            "critical boolean, failure_category string, provider_error string, " + ", ".join(f"check_{c} boolean" for c in S.EVAL_CHECKS)
    checks = [True] * len(S.EVAL_CHECKS)
    rows = [(1, "number", False, 1, "failed", 0, 0, 2.0, False, False, False, "timeout", None, False, *checks[1:]), (1, "number", False, 0, "completed", 2, 3, 1.0, True, False, False, None, None, *checks)]
    assert len(rows[0]) == len(names) + len(checks)
    results = spark.createDataFrame(rows, kinds)
    cases = E.aggregate_cases(results)
    report = json.loads(E.case_reports(cases, results).first().report)
    assert [r["runIndex"] for r in report["runDiagnostics"]] == [0, 1]
    assert report["runDiagnostics"][1]["failedChecks"] == [S.EVAL_CHECKS[0]] and report["runDiagnostics"][0]["failureCategory"] is None
    assert report["statuses"] == ["completed", "failed"] and report["answerStatus"] == "failed" and report["unstable"] is True
    alone = json.loads(E.case_reports(cases, results.limit(0)).first().report)
    assert alone["runDiagnostics"] == []


def test_a_restart_settles_everything_in_one_table(spark):
    documents = spark.createDataFrame([(1, "queued", None), (2, "ready", 5), (3, "extracting", None)], "document_id long, processing_status string, deleted_at long")
    jobs = spark.createDataFrame(
        [(10, 1, "ocr_document", "running", 1, 0, 3, None), (11, 3, "ocr_document", "running", 1, 0, 3, None), (12, 3, "extract_document", "running", 1, 3, 3, None)],
        "job_id long, document_id long, job_type string, status string, created_at long, attempt_count long, max_attempts long, failure_code string")
    pages = spark.createDataFrame([(1, 1, "running"), (1, 2, "ocr_completed"), (2, 1, "running")], "document_id long, page_number long, ocr_status string")
    messages = spark.createDataFrame([(7, 1, "assistant", "streaming", None), (7, 2, "user", "pending", None)], "thread_id long, sequence_number long, role string, status string, error_code string")
    got = {(r.kind, tuple(r.key)): (r.status, r.restart, r.failure_code) for r in Y.recover_interrupted(documents, jobs, pages, messages).collect()}
    assert got == {
        ("document", (1,)): ("queued", "validate", None), ("document", (3,)): ("extraction_failed", None, "EXTRACTION_ATTEMPTS_EXHAUSTED"),
        ("page", (1, 1)): ("pending", None, None), ("job", (10,)): ("running", None, None), ("job", (11,)): ("failed", None, "INTERRUPTED"), ("job", (12,)): ("running", None, None),
        ("answer", (7, 1)): ("interrupted", None, "APP_RESTARTED"), ("answer", (7, 2)): ("pending", None, None),
    }
    empty = Y.recover_interrupted(documents.limit(0), jobs.limit(0), pages.limit(0), messages.limit(0))
    assert empty.count() == 0


def test_a_line_is_parsed_once(spark):
    out = I.parse_layout(lines(spark, json.dumps(PAGE)))
    for table in (out.rejected, out.blocks, out.words):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        # the filter on the fault must not be pushed below the parser, once for each field that it looks at
        assert plan.count("from_json") == 1


def test_parser_output_is_moved_and_written_small(spark, tmp_path):
    folder = tmp_path / "documents.parquet"
    text = "\n".join(" ".join(f"word{i % 7}" for i in range(40)) for _ in range(16))
    spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string").write.parquet(str(folder))
    out = layout_queries.parser_output(spark, str(tmp_path))
    files = out.words.inputFiles()
    assert files and all(f.endswith(".gz") for f in files)
    assert out.words.count() == 40 * 16 * 40
