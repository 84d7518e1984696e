import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from siftwell import cli, schema as S
from siftwell.functions import rules
from siftwell.operators import extract, folds, scoring
from siftwell.plans import stages
from siftwell.sources import filesystem, logs
from siftwell.streaming import scan


def _write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def _docx(path, text="Hello <b>there</b>", size=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "x" * size if size else f"<w>{text}</w>")


def test_extract(tmp_path):
    cases = {
        "a.txt": (b"plain text", "text", "ok", "plain text"),
        "empty.txt": (b"", "text", "no_text", ""),
        "nul.txt": (b"a\x00" * 50, "text", "no_text", ""),
        "few.txt": (b"a" * 200 + b"\x00", "text", "ok", "a" * 200),
        "long.txt": (b"x" * 10_000, "text", "ok", "x" * S.EXCERPT_CHARS),
        "latin.txt": ("é".encode("latin-1") * 5, "text", "ok", "é" * 5),
        "a.rtf": (rb"{\rtf1\ansi\b0 Hello \par world}", "text", "ok", "Hello world"),
        "id_rsa": (b"key text", "binary", "ok", "key text"),
        "store": (b"\x00" * 100, "binary", "unsupported", None),
        "riff": (b"RIFF some text", "binary", "unsupported", None),
        "a.exe": (b"text", "binary", "unsupported", None),
        "a.odt": (b"zip", "doc", "unsupported", None),
        "a.doc": (b"\x00\x01abcd\x02ef\x03ghijk", "doc", "ok", "abcd ghijk"),
        "a.eml": (b"From: a@b\r\nSubject: hi\r\n\r\nbody", "text", "ok", "From: a@b\nSubject: hi\n\nbody"),
        "h.eml": (b"From: a@b\r\nContent-Type: text/html\r\n\r\n<p>body</p>", "text", "ok", "From: a@b\n\n body"),
        "bad.emlx": (b"many\nFrom: a@b\n\nx", "text", "no_text", None),
        "noline.emlx": (b"123", "text", "no_text", None),
        "empty.eml": (b"", "text", "no_text", None),
        "attached.eml": (b'Subject: s\r\nContent-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\nContent-Type: text/html\r\n\r\n<p>h</p>\r\n--b\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename="n.txt"\r\n\r\nplain\r\n--b--\r\n', "text", "ok", "Subject: s\n\nplain"),
    }
    for name, (data, category, status, text) in cases.items():
        _write(tmp_path / name, data)
        ext = name.rsplit(".", 1)[-1] if "." in name else ""
        assert extract.extract(str(tmp_path / name), category, ext, len(data)) == (text, status), name
    message = b"From: a@b\n\nhello"
    _write(tmp_path / "m.emlx", str(len(message)).encode() + b"\n" + message + b"<plist/>")
    assert extract.extract(str(tmp_path / "m.emlx"), "text", "emlx", 50) == ("From: a@b\n\nhello", "ok")
    _docx(tmp_path / "d.docx")
    assert extract.extract(str(tmp_path / "d.docx"), "doc", "docx", 50) == (" Hello  there  ", "ok")
    _docx(tmp_path / "big.docx", size=S.MEMBER_CEILING + 1)
    assert extract.extract(str(tmp_path / "big.docx"), "doc", "docx", 50) == (None, "no_text")
    assert extract.extract(str(tmp_path / "absent.txt"), "text", "txt", 50) == (None, "error")


def _home(root):
    _write(root / ".env", "SECRET=" + "x" * 40)
    _write(root / "_x.txt", "y" * 40)
    _write(root / "tiny.txt", "z")
    _write(root / "node_modules" / "dep.js", "n" * 40)
    _write(root / "proj" / "Cargo.toml", "t" * 40)
    _write(root / "proj" / "target" / "o.txt", "o" * 40)
    _write(root / "proj" / "copy.txt", "y" * 40)
    _write(root / "docs" / "passwords.txt", "my password and secret token " * 3)
    os.symlink(root, root / "docs" / "loop")


def test_walk(spark, tmp_path):
    _home(tmp_path)
    files, errors = filesystem.inventory(spark, [str(tmp_path), str(tmp_path / "absent")])
    rows = files.orderBy("seq").collect()
    names = {os.path.relpath(r["path"], tmp_path) for r in rows}
    assert names == {".env", "_x.txt", "proj/Cargo.toml", "proj/copy.txt", "docs/passwords.txt"}
    assert {os.path.relpath(r["path"], tmp_path): r["dup_of"] for r in rows}["proj/copy.txt"] == str(tmp_path / "_x.txt")
    assert sorted(r["seq"] for r in rows) == list(range(5))
    assert errors.count() == 1


def test_walk_of_a_root_with_a_separator_in_its_name(spark, tmp_path):
    for root in ("a:b", "c;d"):
        (tmp_path / root).mkdir()
        (tmp_path / root / "f.txt").write_text("x")
    found = filesystem.listed(spark, [str(tmp_path / "a:b"), str(tmp_path / "c;d")]).collect()
    assert sorted((r["path"], r["error"]) for r in found) == [(str(tmp_path / root / "f.txt"), None) for root in ("a:b", "c;d")]


def test_a_root_with_one_child_is_dealt_to_many_tasks(spark, tmp_path):
    for i in range(6):
        for j in range(3):
            _write(tmp_path / "only" / f"d{i}" / f"e{j}" / "f.txt", "x" * 40)
    parts = filesystem.FilesReader([str(tmp_path)], 8).partitions()
    assert [p.deep for p in parts] == [False, False, True, True, True, True, True, True]
    for subtrees in (1, 2, 5, 8, 9, 64):
        reader = filesystem.FilesReader([str(tmp_path)], subtrees)
        found = [row[0] for part in reader.partitions() for row in reader.read(part)]
        assert len(found) == len(set(found)) == 18, subtrees
    assert filesystem.listed(spark, [str(tmp_path)]).count() == 18


def test_walk_tells_of_an_entry_that_vanishes(monkeypatch, tmp_path):
    for name in ("gone", "kept"):
        (tmp_path / f"{name}.txt").write_text("x")
        (tmp_path / name).mkdir()
        (tmp_path / name / "below.txt").write_text("x")
    known = filesystem.is_link

    def is_link(entry):
        if entry.name.startswith("gone"):
            raise FileNotFoundError("no such entry")
        return known(entry)

    monkeypatch.setattr(filesystem, "is_link", is_link)
    rows = list(filesystem.FilesReader([]).read(filesystem.Subtree(str(tmp_path), str(tmp_path), deep=True)))
    assert sorted((r[1], r[5]) for r in rows) == [("below.txt", None), ("gone", "no such entry"), ("gone.txt", "no such entry"), ("kept.txt", None)]


def test_logs(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"dedupe_key":"a","path":"/a","probabilities":{"credentials":0.5,"value":{"2":0.7}}}\n\n{"dedupe_key":"b","error":"x"}\n{bad\n')
    rows = logs.results(spark, str(tmp_path / "r.jsonl"), strict=False).orderBy("seq").collect()
    assert [(r["dedupe_key"], r["error"]) for r in rows] == [("a", None), ("b", "x")]
    assert rows[0]["probabilities"]["value"] == {"2": 0.7}
    assert logs.decisions(spark, str(tmp_path / "absent")).count() == 0


def test_commands_from_walk_to_manifest(spark, tmp_path):
    _home(tmp_path / "home")
    folder = str(tmp_path / "run")
    assert cli.main(["walk", "--run", folder, str(tmp_path / "home")], spark) == 0
    run = stages.Run(spark, folder)
    assert stages.estimate(run).first()["files"] == 4
    done = stages.scan(run, scoring.LocalJudge(), batch_size=2, use_prefilter=True)
    assert (done.judged, done.errors, done.stopped) == (4, 0, "")
    assert stages.plan_scan(run).count() == 0  # resumed: nothing is left
    assert stages.scan(run, scoring.LocalJudge(), batch_size=2).judged == 0
    assert "password" in stages.report(run)
    assert cli.main(["manifest", "--run", folder], spark) == 0
    assert "passwords.txt" in (tmp_path / "run" / "manifest" / "credentials.md").read_text()
    assert stages.annotate(run, take_all=True).count() == 0
    assert stages.recognise(run, lambda p: ("ok", "t"), take_all=True).agg(F.sum("files")).first()[0] == 0


def test_scan_stops_on_cap_and_systemic_errors(spark, tmp_path):
    class Failing(scoring.LocalJudge):
        def files(self, states):
            if states[0]["path"].startswith("/canary"):
                return scoring.LocalJudge().files(states)
            raise scoring.CallError("no credit", 402)

    rows = spark.createDataFrame([(f"/f{i}.txt", 40, 0.0, "txt", "text", f"k{i}", i, "x", False, "ok") for i in range(12)], S.CANDIDATE)
    out = scan.run(rows, scoring.LocalJudge(), str(tmp_path / "a"), str(tmp_path / "w1"), cap=850 * 6 * S.PRICE_PER_MILLION / 1e6, batch_size=4)
    assert out.stopped == "cap" and out.judged == 4
    out = scan.run(rows, Failing(), str(tmp_path / "b"), str(tmp_path / "w2"), batch_size=3)
    assert out.stopped == "systemic errors" and out.judged == 6 and out.errors == 6
    assert out.tokens == S.CALL_TOKENS  # errors are free; the canary is not


def test_stream_judges_what_arrives_once(spark, tmp_path):
    _write(tmp_path / "f" / "a.txt", "some notes " * 5)
    inv, _ = filesystem.inventory(spark, [str(tmp_path / "f")])
    logs.overwrite(inv, str(tmp_path / "inv"))
    for _ in range(2):
        scan.start_stream(spark, str(tmp_path / "inv"), scoring.LocalJudge(), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert logs.results(spark, str(tmp_path / "log")).count() == 1


def fixed(value, seconds=0.0):
    class Fixed(scoring.LocalJudge):  # of this function, so that it is shipped by value
        """Judges every file alike."""

        def files(self, states):
            time.sleep(seconds)
            return [x | {"value_score": value} for x in super().files(states)]

    return Fixed()


def _rows(spark, n):
    return spark.createDataFrame([(f"/f{i}.txt", 40, 0.0, "txt", "text", f"k{i}", i, "x", False, "ok") for i in range(n)], S.CANDIDATE)


def counting():
    class Held(float):  # of this function, as its judge, so that they are shipped by value
        """A number that fails when more than a block of them are held."""

        alive = 0

        def __init__(self, _):
            Held.alive += 1
            assert Held.alive <= scoring.BLOCK_ROWS + 20, Held.alive

        def __del__(self):
            Held.alive -= 1

    class Counting(scoring.LocalJudge):
        def files(self, states):
            return [x | {"value_score": Held(int(s["path"][2:-4]) % 7)} for s, x in zip(states, super().files(states), strict=True)]

        def directories(self, states):
            return [x | {"worth_scanning": Held(int(s["path"][2:]) % 7)} for s, x in zip(states, super().directories(states), strict=True)]

    return Counting()


def test_judging_holds_a_block_of_answers(spark):
    rows = _rows(spark, 3000).coalesce(1)
    got = scoring.judge_files(rows, counting()).collect()
    assert [(r["path"], r["seq"], r["value_score"]) for r in got] == [(f"/f{i}.txt", i, i % 7) for i in range(3000)]
    dirs = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("/d"), "id").alias("path"), F.to_json(F.struct(F.concat(F.lit("/d"), "id").alias("path"))).alias("state"), F.col("id").alias("file_count"))
    got = scoring.judge_directories(dirs, counting()).collect()
    assert [(r["path"], r["file_count"], r["worth_scanning"]) for r in got] == [(f"/d{i}", i, i % 7) for i in range(3000)]


def test_answers_that_lack_values_give_nulls(spark):
    class Odd(scoring.LocalJudge):
        def files(self, states):
            at = int(states[0]["path"][2:-4])
            p = [None, {"personal": 1}, {"personal": float("nan"), "value": None}, {"value": {"2": 0.5, "3": None}, "more": 1}, {"value": {}}][at]
            return [{"probabilities": p, "value_score": [1, float("nan"), None, 0.5, 2.0][at], "input_tokens": [7, 7.0, None, float("nan"), 0][at]}]

    got = sorted(scoring.judge_files(_rows(spark, 5).coalesce(1), Odd(), threads=3).collect(), key=lambda r: r["seq"])
    assert [r["value_score"] for r in got] == [1.0, None, None, 0.5, 2.0]
    assert [r["input_tokens"] for r in got] == [7, 7, 851, 851, 0]
    assert [r["probabilities"] and (r["probabilities"]["personal"], r["probabilities"]["value"]) for r in got] == [None, (1.0, None), (None, None), (None, {"2": 0.5, "3": None}), (None, {})]


def test_the_last_scan_wins(spark, tmp_path):
    log = str(tmp_path / "log")
    for value in (1.0, 2.0, 0.5):
        assert scan.run(_rows(spark, 12).repartition(3), fixed(value), log, str(tmp_path / "w"), batch_size=4).judged == 12
        assert {r["value_score"] for r in folds.results_latest(logs.results(spark, log)).collect()} == {value}
    rows = logs.results(spark, log).collect()
    assert len(rows) == len({r["seq"] for r in rows}) == 36


def test_annotation_does_not_hide_a_later_scan(spark, tmp_path):
    _write(tmp_path / "home" / "a.txt", "some notes " * 5)
    run = stages.Run(spark, str(tmp_path / "run"))
    stages.walk(run, [str(tmp_path / "home")])
    key = run.inventory().first()["dedupe_key"]
    old = {"dedupe_key": key, "path": str(tmp_path / "home" / "a.txt"), "size": 55, "category": "text", "probabilities": {"credentials": 0.9}, "value_score": 1.0}
    spark.createDataFrame([json.dumps(old)], "string").write.text(run.path("results"))
    stages.annotate(run, take_all=True)
    assert run.latest().first()["extraction_status"] == "ok"
    scan.run(stages.extracted(run, run.inventory()), fixed(2.5), run.path("results"), run.path("work"))
    assert run.latest().first()["value_score"] == 2.5 and run.latest().count() == 1


def test_a_later_failure_hides_a_recognised_text(spark, tmp_path):
    run = stages.Run(spark, str(tmp_path))
    row = lambda status, text: spark.createDataFrame([("k", "/k", status, len(text or ""), text)], "dedupe_key string, path string, ocr_status string, excerpt_chars int, excerpt string")
    for status, text, count in (("ok", "t", 1), ("error", None, 0), ("ok", "u", 1), ("timeout", None, 0)):
        run.add(row(status, text), "ocr", "dedupe_key")
        assert run.excerpts().count() == count
    for worth in (0.5, 0.01, 0.7):
        run.add(spark.createDataFrame([("/d", 10, worth, "x", 5, None)], "path string, file_count long, worth_scanning double, kind string, input_tokens long, error string"), "prefilter", "path")
        assert run.decisions().first()["worth_scanning"] == worth


def test_calls_run_at_once(spark, tmp_path):
    scan.run(_rows(spark, 2), fixed(1.0), str(tmp_path / "l0"), str(tmp_path / "w0"))  # warm
    start = time.perf_counter()
    out = scan.run(_rows(spark, 400), fixed(1.0, 0.25), str(tmp_path / "log"), str(tmp_path / "w"))
    rate = 400 / (time.perf_counter() - start)
    assert out.judged == 400 and rate > 10, rate


def test_staged_answers_of_a_stopped_run_are_logged(spark, tmp_path):
    log, work = str(tmp_path / "log"), str(tmp_path / "w")
    scan.run(_rows(spark, 4), fixed(1.0), log, work)
    staged = logs.numbered(scoring.judge_files(_rows(spark, 6), fixed(2.0)), logs.next_append(spark, log), "dedupe_key")
    staged.write.parquet(f"{work}/answers")
    assert scan.run(_rows(spark, 0), fixed(1.0), log, work).judged == 0
    assert {r["value_score"] for r in folds.results_latest(logs.results(spark, log)).collect()} == {2.0} and logs.results(spark, log).count() == 10


def test_one_budget_serves_directories_and_files(spark, tmp_path):
    for i in range(12):
        _write(tmp_path / "home" / "documents" / f"{i}.txt", f"note {i} " * 8)
    run = stages.Run(spark, str(tmp_path / "run"))
    stages.walk(run, [str(tmp_path / "home")])
    out = stages.scan(run, scoring.LocalJudge(), cap=850 * 7 * S.PRICE_PER_MILLION / 1e6, batch_size=4, use_prefilter=True)
    assert out.stopped == "cap" and out.judged == 4  # one directory, the canary and four files


def test_a_stream_over_its_cap_loses_no_row(spark, tmp_path):
    for i in range(3):
        _write(tmp_path / "f" / f"{i}.txt", f"some notes {i} " * 5)
    inv, _ = filesystem.inventory(spark, [str(tmp_path / "f")])
    logs.overwrite(inv, str(tmp_path / "inv"))
    start = lambda cap, judge=scoring.LocalJudge(): scan.start_stream(spark, str(tmp_path / "inv"), judge, str(tmp_path / "log"), str(tmp_path / "cp"), cap).awaitTermination()
    with pytest.raises(Exception, match="cap"):
        start(0.0)
    assert not logs.exists(spark, str(tmp_path / "log"))
    start(5.0)
    assert logs.results(spark, str(tmp_path / "log")).count() == 3


def test_categories_of_rules_are_all_known():
    assert set(rules.EXTENSIONS) | {"binary"} == set(S.FILE_CATEGORIES)
