import json
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell import schema as S
from siftwell.functions import text
from siftwell.operators import budget, dedupe, folds, listings, metrics, ocr, outputs, ranking, rollups, selection
from siftwell.sources import adapters, logs

P = (0.0, 0.0, 0.0, 0.0, 0.0, None)


def results(spark, rows):
    """Rows (key, value, error, seq, ...)."""
    full = [(k, f"/d/{k}.txt", 10, "text", P, v, 0.5, 1, False, "ok", 2, e, s) for k, v, e, s in rows]
    return spark.createDataFrame(full, S.RESULTS)


def test_fold_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(20)}", rng.random(), rng.choice([None, None, "bad", ""]), i) for i in range(300)]
    want: dict = {}
    for k, v, e, s in rows:
        if k not in want or not e or want[k][1]:
            want[k] = (v, e, s)
    got = {r["dedupe_key"]: (r["value_score"], r["error"], r["seq"]) for r in folds.results_latest(results(spark, rows)).collect()}
    assert got == want


def test_fold_keeps_success_over_later_error(spark):
    got = folds.results_latest(results(spark, [("a", 1.0, None, 0), ("a", None, "x", 1), ("b", None, "A", 2), ("b", None, "B", 3)])).orderBy("dedupe_key").collect()
    assert [(r["value_score"], r["error"], r["first_seq"]) for r in got] == [(1.0, None, 0), (None, "B", 2)]


def test_resolved_keys_count_an_empty_error_as_open(spark):
    got = folds.resolved_keys(results(spark, [("a", 1.0, None, 0), ("b", None, "x", 1), ("c", None, "", 2)])).collect()
    assert [r[0] for r in got] == ["a"]


def test_ocr_fold_lets_a_failure_hide_an_earlier_text(spark):
    log = spark.createDataFrame([("a", "/a", "ok", 1, "t", 0), ("a", "/a", "error", 0, None, 1), ("b", "/b", "error", 0, None, 2), ("b", "/b", "ok", 1, "u", 3)], S.OCR_LOG)
    assert [r["dedupe_key"] for r in folds.ocr_excerpts(log).collect()] == ["b"]


def inventory(spark, rows):
    return spark.createDataFrame([(p, s, 0.0, p.rsplit(".", 1)[-1], c, k, d, i, "/") for i, (p, s, c, k, d) in enumerate(rows)], S.INVENTORY)


def test_duplicates_two_ways(spark):
    inv = inventory(spark, [("/a.txt", 40, "text", "k", None), ("/b.txt", 40, "text", "k", None), ("/c.txt", 40, "text", "l", None)])
    for marked in (dedupe.mark_duplicates(inv), dedupe.first_in_key(inv)):
        assert [r["dup_of"] for r in marked.orderBy("seq").collect()] == [None, "/a.txt", None]


def test_eligible(spark):
    inv = inventory(spark, [("/a.txt", 40, "text", "a", None), ("/b.txt", 40, "text", "b", "/a.txt"), ("/c.meta", 40, "generated", "c", None), ("/d.PY", 40, "code", "d", None), ("/e.md", 40, "text", "e", None)])
    keys = lambda df: [r["dedupe_key"] for r in df.orderBy("seq").collect()]
    done = inv.filter("dedupe_key = 'a'")
    assert keys(selection.eligible(inv)) == ["a", "d", "e"]
    assert keys(selection.eligible(inv, done)) == ["d", "e"]
    assert keys(selection.eligible(inv, done, only_keys=done)) == ["a"]
    assert keys(selection.eligible(inv, exclude_exts=["py"])) == ["a", "e"]
    assert keys(selection.eligible(inv, limit=1)) == ["a"]


def test_outdated_rubric_takes_missing_versions(spark):
    rows = [("a", 1), ("b", None), ("c", 2)]
    df = spark.createDataFrame([(k, f"/{k}", 1, "text", P, 1.0, 0.5, 1, False, "ok", v, None, 0) for k, v in rows], S.RESULTS)
    assert sorted(r[0] for r in selection.outdated_keys(df).collect()) == ["a", "b"]


def test_listing_floor_children_and_bytes(spark):
    rows = [(f"/r/big/f{i}.svg", 100, "text", f"k{i}", None) for i in range(12)] + [("/r/small/a.txt", 40, "text", "s", None), ("/r/big/sub/deep/x.txt", 40, "text", "x", None)]
    inv = inventory(spark, rows)
    found = listings.listings(inv, inv).collect()
    assert [(r["path"], r["file_count"], r["total_bytes"], r["extensions"], r["subdirectories"]) for r in found] == [("/r/big", 12, 1200, {"svg": 12}, ["sub"])]
    assert listings.state(listings.listings(inv, inv)).count() == 1


@pytest.mark.parametrize("n", [1, 39, 40, 41, 50, 97, 400])
def test_name_sample(spark, n):
    files = spark.createDataFrame([("/d", f"{i:04d}.svg", i) for i in range(n)], "dir string, name string, seq long")
    got = [r["name"] for r in listings.name_sample(files).orderBy("pos").collect()]
    names = [f"{i:04d}.svg" for i in range(n)]
    assert got == (names if n <= 40 else [names[int(k * (n / 40))] for k in range(40)])


@pytest.mark.parametrize("range_rows", [0, 100, 10_000])
def test_name_sample_by_ranges(spark, range_rows):
    rng = random.Random(5)
    rows = [(d, rng.choice(["Same", "same", f"n{rng.randrange(300)}", f"N{i}", ""]), i) for i in range(1200) for d in ("/a", "/a", "/a", "/b")[i % 4 : i % 4 + 1]]
    want = {}
    for d in ("/a", "/b"):
        names = [n for _, n, _ in sorted((r for r in rows if r[0] == d), key=lambda r: (r[1].lower(), r[2]))]
        want |= {(d, k): names[int(k * (len(names) / 40))] for k in range(40)}
    files = spark.createDataFrame(rows, "dir string, name string, seq long").repartition(7)
    assert {(r["path"], r["pos"]): r["name"] for r in listings.name_sample(files, range_rows=range_rows).collect()} == want


def test_lines_become_one_file_in_order(spark, tmp_path):
    logs.write_lines(spark.range(1000, numPartitions=13).orderBy(F.desc("id")).select(F.col("id").cast("string").alias("value")), str(tmp_path / "a" / "out.txt"))
    assert (tmp_path / "a" / "out.txt").read_text() == "".join(f"{i}\n" for i in reversed(range(1000)))
    logs.write_lines(spark.createDataFrame([], "value string"), str(tmp_path / "a" / "out.txt"))
    assert (tmp_path / "a" / "out.txt").read_text() == "" and not (tmp_path / "a" / "out.txt.parts").exists()
    logs.write_text(spark, str(tmp_path / "b.md"), (f"é{i}" for i in range(25_000)))
    assert (tmp_path / "b.md").read_text() == "".join(f"é{i}\n" for i in range(25_000))


def test_decisions_drop_only_judged_directories(spark):
    inv = inventory(spark, [("/a/x.txt", 40, "text", "a", None), ("/b/x.txt", 40, "text", "b", None), ("/c/x.txt", 40, "text", "c", None)])
    listed = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "path string")
    judged = spark.createDataFrame([("/a", 0.04), ("/b", 0.05)], "path string, worth_scanning double")
    assert sorted(r["path"] for r in selection.apply_decisions(inv, listed, judged).collect()) == ["/b/x.txt", "/c/x.txt"]


def test_collapse(spark):
    rows = spark.createDataFrame([("/d", i) for i in range(5)] + [("/e", i) for i in range(3)], "dir string, first_seq long")
    got = ranking.collapse_siblings(rows, [], [F.col("first_seq")]).orderBy("dir", "first_seq").collect()
    assert [(r["dir"], r["hidden"]) for r in got] == [("/d", 0)] * 3 + [("/d", 2)] + [("/e", 0)] * 3


def test_budget_cut_breaker_and_pacer(spark):
    batches = spark.createDataFrame([(0, 10, 10), (1, 10, 10**9), (2, 1, 1)], "batch long, tokens long, worst_tokens long")
    assert [r["batch"] for r in budget.cut_at_cap(batches, 1.0).collect()] == [0]
    live = budget.Budget(cap=0.042)
    live.record(999_999)
    assert not live.would_exceed(1) and live.would_exceed(2)
    breaker = budget.Breaker()
    assert [breaker.record(s) for s in (401, 402, 403, 401, 500, 401, 401, 401, 401, 401)] == [False] * 9 + [True]

    class Clock:
        now, slept = 0.0, 0.0

        def monotonic(self):
            return self.now

        def sleep(self, s):
            self.now, self.slept = self.now + s, self.slept + s

    clock = Clock()
    pacer = budget.Pacer(30, clock)
    for _ in range(3):
        pacer.wait()
    assert clock.slept == pytest.approx(4.0)


def test_error_streaks(spark):
    log = spark.createDataFrame([(i, s) for i, s in enumerate([401, 402, None, 403, 500, 401])], "seq long, http_status int")
    assert sorted((r["start_seq"], r["length"]) for r in budget.error_streaks(log).collect()) == [(0, 2), (3, 1), (5, 1)]


def test_spearman(spark):
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (3.0, 9.0), (None, 1.0)], "a double, b double")
    row = metrics.spearman(pairs).first()
    assert row["pairs"] == 4 and row["spearman"] == pytest.approx(8 / 9)


def test_tree_page_and_outputs(spark, small, tmp_path):
    latest = adapters.judged(spark, small).persist()
    nodes = outputs.tree(latest)
    assert sum(n["notable_subtree"] for n in nodes) == rollups.subtree_rollup(latest).filter("dir = '/'").first()["notable_subtree"]
    assert "</script><" not in outputs.page(latest).split('type="application/json">')[1].split("</script>")[0]
    outputs.write_manifest(latest, str(tmp_path))
    listed = (tmp_path / "copy-list.txt").read_text().splitlines()
    assert listed == [r["path"] for r in outputs.manifest_rows(latest).orderBy(*ranking.copy_order()).collect()]
    parts = [(tmp_path / f"copy-list-{n}.txt").read_text().splitlines() for n in ("verified", "name-only")]
    assert sorted(parts[0] + parts[1]) == sorted(listed)
    shown = (tmp_path / "by-category.md").read_text().split("\n## ")
    assert [part.split("\n")[0] for part in shown[1:]] == list(S.CATEGORIES)
    assert sum(part.count("\n1. ") for part in shown) == outputs.manifest_categories(latest).filter("rank = 1").count()
    assert (tmp_path / "summary.txt").read_text().startswith(f"Files: {len(listed):,}")
    assert "# Report" in outputs.report_markdown(latest)
    outputs.write_csv(latest, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == latest.count()


def _scripted(folder, name):
    """The calls of a page's scripts, in order: (function, arguments)."""
    calls = []
    for script in sorted((folder / name).glob("*.js")):
        for line in script.read_text("utf-8").splitlines():
            called, arguments = re.fullmatch(r"(\w+)\((.*)\);", line).groups()
            calls.append((called, json.loads(f"[{arguments}]")))
    return calls


def test_page_files_are_all_written_best_first(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "SCRIPT_ROWS", 7)
    latest = adapters.judged(spark, small).persist()
    outputs.write_page(latest, str(tmp_path))
    data = json.loads((tmp_path / "report.html").read_text().split('type="application/json">')[1].split("</script>")[0])
    assert data["files"] == [f"report-files/{p.name}" for p in sorted((tmp_path / "report-files").glob("*.js"))] and len(data["files"]) > 3
    dirs = dict(a for _, a in _scripted(tmp_path, "report-dirs"))
    assert sorted(dirs) == list(range(len(dirs)))
    files = [a[0] for _, a in _scripted(tmp_path, "report-files")]
    wanted = [r for r in latest.orderBy("first_seq").collect() if r["path"] in {m["path"] for m in outputs.manifest_rows(latest, S.MIN_VALUE, S.REPORT_MIN_PROB).collect()} and r["value_score"] is not None]
    assert sorted(dirs[f["dir"]] + f["name"] for f in files) == sorted(r["path"] for r in wanted)
    assert data["summary"]["notable"] == len(files) == len(wanted)
    assert [f["value"] for f in files] == sorted((round(r["value_score"], 2) for r in wanted), reverse=True)
    seen = list(dict.fromkeys(r["path"].rsplit("/", 1)[0] + "/" for r in wanted))
    assert [dirs[k] for k in range(len(dirs))] == seen
    for row in data["tallies"]:
        assert row["files"] == sum(f["probs"].get(row["category_name"], 0) >= S.REPORT_MIN_PROB for f in files) == row["verified"] + row["name_only"]


def test_page_of_nothing_and_of_odd_names(spark, tmp_path):
    outputs.write_page(folds.results_latest(spark.createDataFrame([], S.RESULTS)), str(tmp_path / "none"))
    assert not list((tmp_path / "none" / "report-files").glob("*.js"))
    names = ['C:\\d "q"\\a\\b.txt', "/é/</script>.txt", "bare.txt"]
    rows = [(f"k{i}", p, None, "text", (0.9, None, 0.0, 0.0, 0.0, None), 2.125, None, 1, False, "ok", 2, None, i) for i, p in enumerate(names)]
    latest = folds.results_latest(spark.createDataFrame(rows, S.RESULTS))
    outputs.write_page(latest, str(tmp_path / "odd"))
    dirs = dict(a for _, a in _scripted(tmp_path / "odd", "report-dirs"))
    files = [a[0] for _, a in _scripted(tmp_path / "odd", "report-files")]
    assert [dirs[f["dir"]] + f["name"] for f in files] == names
    assert files[0] == {"dir": 0, "name": "b.txt", "size": 0, "value": 2.12, "confidence": 0.0, "verified": "content", "probs": {"credentials": 0.9, "financial_legal": 0.0, "original_work": 0.0, "irreplaceable": 0.0}}


@given(st.floats(0, 1e6) | st.integers(0, 10**6).map(lambda n: n / 200) | st.integers(0, 10**6).map(lambda n: n / 800))
@settings(max_examples=300, deadline=None)
def test_two_places_in_plain_floats(value):
    """The rule of ``text.two_places`` on Python floats."""
    low = math.floor(value * 100)
    middle = (2 * low + 1.0) / 200
    error = (2 * low + 1.0) - middle * 128 - middle * 64 - middle * 8
    up = value > middle or (value == middle and (error < 0 or (error == 0 and low % 2 == 1)))
    assert (low + up) / 100 == round(value, 2)


def test_two_places(spark):
    values = [0.0, 0.125, 0.375, 0.675, 2.675, 1.005, 0.29, 0.57, 1.0, 3.0, 0.015, 0.025, 1e-300, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(text.two_places(F.col("v"))).collect()]
    assert got == [None if v is None else round(v, 2) for v in values]


def test_chain_of_single_children_is_joined(spark):
    rows = [("a", "/x/y/z/f.txt", 10, "text", (0.9, 0.0, 0.0, 0.0, 0.0, None), 2.5, 0.5, 1, False, "ok", 2, None, 0), ("b", "/x/q.txt", 10, "text", P, 0.1, 0.5, 1, False, "ok", 2, None, 1)]
    latest = folds.results_latest(spark.createDataFrame(rows, S.RESULTS))
    (node,) = outputs.tree(latest)
    assert (node["name"], node["path"], node["scanned_subtree"], node["credentials"]) == ("/x/y/z", "/x/y/z", 2, 1)


def test_ocr_run_and_counts(spark):
    rows = spark.createDataFrame([("a", "/a.png"), ("b", "/b.png")], "dedupe_key string, path string")
    log = ocr.run(rows, lambda p: ("ok", "text") if p == "/a.png" else ("timeout", ""))
    assert {r["dedupe_key"]: (r["ocr_status"], r["excerpt"]) for r in log.collect()} == {"a": ("ok", "text"), "b": ("timeout", None)}
    assert {r["ocr_status"]: r["files"] for r in ocr.status_counts(log).collect()} == {"ok": 1, "no_text": 0, "timeout": 1, "error": 0, "unavailable": 0}


def test_excerpts_never_reach_report_rows(spark, small):
    assert "excerpt" not in outputs.report_csv(adapters.judged(spark, small)).columns


def test_repository_and_sync_flags(spark):
    files = spark.createDataFrame([("/a/.git/config",), ("/a/src/x.py",), ("/b/x.py",), ("/c/OneDrive - me/x.txt",)], "path string")
    got = {r["path"]: (r["in_repository"], r["synced"]) for r in selection.in_repositories(files).withColumn("synced", selection.is_synced(F.col("path"))).collect()}
    assert got == {"/a/.git/config": (True, False), "/a/src/x.py": (True, False), "/b/x.py": (False, False), "/c/OneDrive - me/x.txt": (False, True)}
