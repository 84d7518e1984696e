"""Reports, manifests and pages: tables are made in the cluster, texts from rows already limited."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell import schema as S
from siftwell.functions import paths, rules, text
from siftwell.operators import ranking, rollups
from siftwell.sources import logs


def report_csv(latest: DataFrame) -> DataFrame:
    """All latest rows, errors included, one column per category; a missing probability is empty."""
    return latest.orderBy("first_seq").select(
        "dedupe_key", "path", "size", "category", "value_score", "value_confidence", rules.top_category().alias("top_category"),
        rules.verified_label(F.col("extraction_status")).alias("verified"), "extraction_status", "rubric_version", "input_tokens", "error",
        *[rules.probability(c).alias(c) for c in S.CATEGORIES],
    )


def write_csv(latest: DataFrame, folder: str) -> None:
    report_csv(latest).write.mode("overwrite").csv(folder, header=True, emptyValue="", nullValue="")


def _row_line(row, score: float) -> str:
    if row["hidden"]:
        return f"- … {row['hidden']} more in `{row['dir']}`"
    return f"{row['rank']}. {score:.2f} `{row['path']}` ({row['label']})"


def overall_section(latest: DataFrame, top: int = S.REPORT_TOP) -> DataFrame:
    """The best rows, cut before they are split and collapsed: section, rank, path, hidden, ..."""
    rows = ranking.split_sections(ranking.overall_top(latest, top)).withColumn("dir", paths.parent(F.col("path"))).withColumn("label", rules.verified_label(F.col("extraction_status")))
    return ranking.collapse_siblings(rows, ["section"], [F.col("rank")])


def category_section(latest: DataFrame, min_prob: float = S.REPORT_MIN_PROB, top: int = S.CATEGORY_TOP) -> DataFrame:
    rows = ranking.split_sections(ranking.category_top(latest, min_prob, top)).withColumn("dir", paths.parent(F.col("path"))).withColumn("label", rules.verified_label(F.col("extraction_status")))
    return ranking.collapse_siblings(rows, ["category_name", "section"], [F.col("rank")])


def report_markdown(latest: DataFrame, top: int = S.REPORT_TOP, min_prob: float = S.REPORT_MIN_PROB, min_value: float = S.MIN_VALUE) -> str:
    """The report's text; it collects some hundred rows at most."""
    summary = rollups.report_summary(latest, min_value, min_prob).first()
    lines = ["# Report", "", f"{summary['scanned']} judged, {summary['errors']} errors, {summary['notable']} notable, spent ${summary['spend'] or 0:.4f}", ""]
    titles = {"verified": "Verified by content", "unverified": "Name-only matches (unverified)"}
    overall = overall_section(latest, top).orderBy("section", "rank").collect()
    for section in ("verified", "unverified"):
        lines += [f"## {titles[section]}", "", *[_row_line(r, r["value_score"]) for r in overall if r["section"] == section], ""]
    categories = category_section(latest, min_prob).orderBy("category_name", "section", "rank").collect()
    for name in S.CATEGORIES:
        lines += [f"## {name}", ""]
        for section in ("verified", "unverified"):
            own = [r for r in categories if r["category_name"] == name and r["section"] == section]
            lines += [f"### {titles[section]}", "", *[_row_line(r, r["probability"]) for r in own], ""] if own else []
    return "\n".join(lines)


def manifest_rows(latest: DataFrame, min_value: float = S.MIN_VALUE, min_prob: float = S.MANIFEST_MIN_PROB) -> DataFrame:
    return latest.filter(rules.is_included(min_value, min_prob)).withColumn("verified", rules.verified_label(F.col("extraction_status")).isin("content", "ocr"))


def write_copy_list(rows: DataFrame, path: str) -> None:
    """Paths in copy order as one text file; ranges of the order are written side by side."""
    logs.write_lines(rows.orderBy(*ranking.copy_order()).select(F.col("path").alias("value")), path)


def credential_lines(latest: DataFrame, min_prob: float = S.CREDENTIAL_WARNING) -> Iterator[str]:
    """Names and places only; contents are never shown. Rows come one partition at a time."""
    yield from ("# Possible credentials", "")
    for row in rollups.credential_warnings(latest, min_prob).select("path", "credential_prob").toLocalIterator():
        yield f"- {row['credential_prob']:.2f} `{row['path']}`"


def manifest_categories(latest: DataFrame, min_value: float = S.MIN_VALUE, min_prob: float = S.MANIFEST_MIN_PROB) -> DataFrame:
    """Included rows of each category, most probable first, siblings collapsed, ranks counting shown rows alone."""
    from pyspark.sql import Window

    rows = ranking.by_category(manifest_rows(latest, min_value, min_prob), min_prob).withColumn("dir", paths.parent(F.col("path"))).withColumn("label", rules.verified_label(F.col("extraction_status")))
    shown = ranking.collapse_siblings(rows, ["category_name"], [F.desc("probability"), F.col("first_seq")])
    order = Window.partitionBy("category_name", F.col("hidden") > 0).orderBy(F.desc("probability"), "first_seq")
    return shown.withColumn("rank", F.when(F.col("hidden") == 0, F.row_number().over(order)))


def summary_text(rows: DataFrame, min_prob: float = S.MANIFEST_MIN_PROB, top: int = S.ROLLUP_TOP) -> str:
    totals = rollups.manifest_totals(rows, min_prob).first()
    lines = [f"Files: {totals['files']:,} ({totals['verified']:,} verified, {totals['name_only']:,} by name only)", f"Bytes: {totals['bytes']:,}", ""]
    lines += [f"{c}: {totals[c]:,}" for c in S.CATEGORIES]
    lines += ["", "Directories:", *[f"  {r['files']:>6} {r['dir']}" for r in rollups.directory_rollup(rows, top).collect()]]
    return "\n".join(lines) + "\n"


def category_lines(latest: DataFrame, min_value: float = S.MIN_VALUE, min_prob: float = S.MANIFEST_MIN_PROB) -> Iterator[str]:
    """A heading for each category, then its rows. Rows come one partition at a time."""
    place = F.array_position(F.array(*map(F.lit, S.CATEGORIES)), F.col("category_name"))
    shown = manifest_categories(latest, min_value, min_prob).orderBy(place, F.desc("probability"), "first_seq")
    groups = groupby(shown.toLocalIterator(), key=lambda r: r["category_name"])
    found = next(groups, None)
    yield from ("# By category", "")
    for name in S.CATEGORIES:
        yield from (f"## {name}", "")
        if found is not None and found[0] == name:
            yield from (_row_line(r, r["probability"]) for r in found[1])
            found = next(groups, None)
        yield ""


def write_manifest(latest: DataFrame, folder: str, min_value: float = S.MIN_VALUE, min_prob: float = S.MANIFEST_MIN_PROB) -> None:
    """Three copy lists, the credential warning, the categories and the summary below ``folder``."""
    spark, rows = latest.sparkSession, manifest_rows(latest, min_value, min_prob)
    write_copy_list(rows, f"{folder}/copy-list.txt")
    write_copy_list(rows.filter("verified"), f"{folder}/copy-list-verified.txt")
    write_copy_list(rows.filter("not verified"), f"{folder}/copy-list-name-only.txt")
    logs.write_text(spark, f"{folder}/credentials.md", credential_lines(latest))
    logs.write_text(spark, f"{folder}/by-category.md", category_lines(latest, min_value, min_prob))
    logs.write_text(spark, f"{folder}/summary.txt", [summary_text(rows, min_prob).removesuffix("\n")])


def tree(latest: DataFrame, min_value: float = S.MIN_VALUE, min_prob: float = S.REPORT_MIN_PROB) -> list[dict]:
    """The notable directories as nested nodes, single-child chains joined.

    Collected are the directories with something notable below them, which the
    page shows all; files stay in the cluster.
    """
    rows = rollups.subtree_rollup(latest, min_value, min_prob).filter("notable_subtree > 0").withColumn("up", paths.parent(F.col("dir"))).withColumn("name", paths.name(F.col("dir"))).collect()
    children: dict[str | None, list] = {}
    known = {r["dir"] for r in rows}
    for r in rows:
        children.setdefault(r["up"] if r["up"] in known and r["up"] != r["dir"] else None, []).append(r)

    def node(row) -> dict:
        below = sorted((node(c) for c in children.get(row["dir"], [])), key=lambda n: (-n["notable_subtree"], n["name"].lower()))
        name = row["name"] or row["dir"]
        if not row["notable_direct"] and len(below) == 1:
            only = below[0]
            sep = "" if name.endswith(("/", "\\")) else "\\" if "\\" in row["dir"] else "/"
            return only | {"name": f"{name}{sep}{only['name']}", "scanned_subtree": row["scanned_subtree"]}
        counts = {k: row[k] for k in ("scanned_subtree", "notable_subtree", "notable_direct", *S.CATEGORIES, "max_value", "notable_bytes")}
        return {"name": name, "path": row["dir"], "children": below} | counts

    return sorted((node(r) for r in children.get(None, [])), key=lambda n: -n["notable_subtree"])


PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>Report</title><style>
body { font: 14px sans-serif; margin: 2em } td, th { padding: 2px 8px; text-align: left } details { margin-left: 1em }
</style></head><body><h1>Report</h1><p id="summary"></p><table id="categories"></table>
<h2>Directories</h2><div id="tops"></div><div id="tree"></div>
<h2>Files</h2><p><input id="find" placeholder="part of a path"> <select id="category"><option value="">all categories</option></select>
<select id="verified"><option value="">all labels</option></select> <button id="under" hidden></button> <span id="count"></span></p>
<table><thead id="head"></thead><tbody id="rows"></tbody></table><button id="more">more rows</button> <button id="load">load more files</button> <button id="all">load all</button>
<script id="data" type="application/json">__DATA__</script><script>
const d = JSON.parse(document.getElementById("data").textContent), at = id => document.getElementById(id);
const dirs = new Map(), files = [];
let loaded = 0, shown = d.page_rows, under = null, key = "value", down = true;
function dir(n, path) { dirs.set(n, path); }
function file(f) { f.path = dirs.get(f.dir) + f.name; files.push(f); }
function make(tag, text, click) { const e = document.createElement(tag); e.textContent = text; if (click) e.onclick = click; return e; }
function bytes(n) { const units = ["B", "KB", "MB", "GB", "TB"]; let i = 0; for (; n >= 1024 && i < 4; i++) n /= 1024; return (i ? n.toFixed(1) : n) + " " + units[i]; }
function inside(path, top) { const end = /[\\\\/]$/.test(top) ? "" : "\\\\/"; return path.startsWith(top) && (!end || end.includes(path[top.length])); }
function script(name) { return new Promise((done, failed) => { const e = document.createElement("script"); e.src = name; e.onload = done; e.onerror = failed; document.body.append(e); }); }
async function load(upto) { while (loaded < Math.min(upto, d.files.length)) await script(d.files[loaded++]); draw(); }
function top_category(f) { return d.categories.filter(c => c in f.probs).reduce((a, c) => a && f.probs[a] >= f.probs[c] ? a : c, null); }
const columns = { value: f => f.value, confidence: f => f.confidence, verified: f => f.verified, size: f => f.size, probability: f => f.probs[at("category").value] ?? 0, path: f => f.path.toLowerCase() };
function draw() {
 const text = at("find").value.toLowerCase(), category = at("category").value, label = at("verified").value, by = columns[key];
 const found = files.filter(f => f.path.toLowerCase().includes(text) && (!category || (f.probs[category] ?? 0) >= d.min_prob) && (!label || f.verified === label) && (under === null || inside(f.path, under)));
 found.sort((a, b) => (by(a) < by(b) ? -1 : by(a) > by(b) ? 1 : 0) * (down ? -1 : 1) || b.value - a.value);
 const head = document.createElement("tr");
 for (const c of Object.keys(columns)) head.append(make("th", c + (c === key ? (down ? " \\u25be" : " \\u25b4") : ""), () => { down = c === key ? !down : c !== "path"; key = c; draw(); }));
 at("head").replaceChildren(head);
 at("rows").replaceChildren(...found.slice(0, shown).map(f => { const row = document.createElement("tr"), best = category || top_category(f);
  for (const cell of [f.value.toFixed(2), f.confidence.toFixed(2), f.verified, bytes(f.size), best ? best + " " + (f.probs[best] ?? 0).toFixed(2) : "-", f.path]) row.append(make("td", cell)); return row; }));
 at("count").textContent = `${Math.min(shown, found.length)} of ${found.length} rows; ${files.length} of ${d.summary.notable} notable files loaded, best first`;
 at("under").hidden = under === null; at("under").textContent = "only below " + under + ": show all";
 at("more").hidden = shown >= found.length; at("load").hidden = at("all").hidden = loaded >= d.files.length;
}
function choose(path) { under = path; shown = d.page_rows; draw(); }
function branch(n) { const e = document.createElement("details"), s = make("summary", `${n.name}: ${n.notable_subtree} of ${n.scanned_subtree}, ${bytes(n.notable_bytes)}, best ${n.max_value} `);
 s.append(make("button", "files", event => { event.preventDefault(); choose(n.path); })); e.append(s);
 e.addEventListener("toggle", () => { if (e.open && e.children.length === 1) n.children.forEach(c => e.append(branch(c))); }); return e; }
at("summary").textContent = `${d.summary.scanned} judged, ${d.summary.errors} errors, ${d.summary.notable} notable, ${d.summary.credential_hits} with credentials, spent $${(d.summary.spend ?? 0).toFixed(4)}`;
at("categories").append(...d.tallies.map(t => { const row = document.createElement("tr"); for (const cell of [t.category_name, t.files, t.verified + " verified", t.name_only + " by name"]) row.append(make("td", cell)); return row; }));
at("tops").append(...d.directories.map(t => make("div", `${t.files} ${t.dir}`, () => choose(t.dir))));
d.tree.forEach(n => at("tree").append(branch(n)));
d.categories.forEach(c => at("category").append(new Option(c, c)));
d.labels.forEach(c => at("verified").append(new Option(c, c)));
for (const id of ["find", "category", "verified"]) at(id).addEventListener("input", () => { shown = d.page_rows; draw(); });
at("under").onclick = () => choose(null);
at("more").onclick = () => { shown += d.page_rows; draw(); };
at("load").onclick = () => load(loaded + 1);
at("all").onclick = () => load(d.files.length);
(async () => { for (const name of d.dirs) await script(name); load(1); })();
</script></body></html>
"""


def page_rows(latest: DataFrame, min_value: float = S.MIN_VALUE, min_prob: float = S.REPORT_MIN_PROB) -> DataFrame:
    """The notable files of the page, numbers to two places: dir, dir_path, name, size, value, confidence, verified, probs, first_seq.

    ``dir`` numbers directories from 0 in the order their first notable file
    appeared. They are numbered by ranges, not by one sort.
    """
    from siftwell.operators import metrics

    rows = latest.filter(rules.is_valid() & rules.is_included(min_value, min_prob)).withColumn("_dir", paths.parent(F.col("path")))
    first = rows.groupBy("_dir").agg(F.min("first_seq").cast("double").alias("_first"), F.lit(1).alias("_n"))
    numbers = metrics.rows_below(first, "_first").select("_dir", F.col("below").alias("dir"))
    probabilities = F.struct(*[text.two_places(rules.probability(c)).alias(c) for c in S.CATEGORIES])
    return rows.join(numbers, "_dir").select(
        "dir", paths.join(F.col("_dir"), F.lit("")).alias("dir_path"), paths.name(F.col("path")).alias("name"), F.coalesce("size", F.lit(0)).alias("size"),
        text.two_places(F.col("value_score")).alias("value"), text.two_places(F.coalesce("value_confidence", F.lit(0.0))).alias("confidence"),
        rules.verified_label(F.col("extraction_status")).alias("verified"), probabilities.alias("probs"), "first_seq",
    )


def page(latest: DataFrame, min_value: float = S.MIN_VALUE, min_prob: float = S.REPORT_MIN_PROB, dirs: Sequence[str] = (), files: Sequence[str] = ()) -> str:
    """The report page: its data as ASCII JSON that can't close the script element.

    Files are not in it; the page reads them from the scripts ``dirs`` and
    ``files``, the latter one by one, best files first.
    """
    summary = rollups.report_summary(latest, min_value, min_prob).first().asDict()
    tallies = {r["category_name"]: r.asDict() for r in rollups.category_tallies(latest.filter(rules.is_included(min_value, min_prob)), min_prob).collect()}
    tops = [r.asDict() for r in rollups.directory_rollup(manifest_rows(latest, min_value, min_prob), S.PAGE_TOP_DIRS).collect()]
    none = {"files": 0, "verified": 0, "name_only": 0}
    data = {
        "summary": summary, "tallies": [tallies.get(c, none | {"category_name": c}) for c in S.CATEGORIES], "directories": tops, "tree": tree(latest, min_value, min_prob),
        "categories": S.CATEGORIES, "labels": S.VERIFIED_LABELS, "min_prob": min_prob, "page_rows": S.PAGE_ROWS, "dirs": list(dirs), "files": list(files),
    }
    return PAGE.replace("__DATA__", json.dumps(data, ensure_ascii=True).replace("</", "<\\/"))


def write_page(latest: DataFrame, folder: str, min_value: float = S.MIN_VALUE, min_prob: float = S.REPORT_MIN_PROB) -> None:
    """``report.html`` and, beside it, scripts with every notable file: written in the cluster, none of them collected."""
    rows = page_rows(latest, min_value, min_prob)
    entry = F.to_json(F.struct("dir", "name", "size", "value", "confidence", "verified", "probs"))
    dirs = rows.select("dir", "dir_path").distinct().select(F.concat(F.lit("dir("), F.col("dir").cast("string"), F.lit(","), _quoted("dir_path"), F.lit(");")).alias("value"))
    files = rows.orderBy(F.desc("value"), "first_seq").select(F.concat(F.lit("file("), entry, F.lit(");")).alias("value"))
    names = {}
    for name, lines in (("report-dirs", dirs), ("report-files", files)):
        names[name] = [f"{name}/{part}" for part in logs.write_scripts(lines, f"{folder}/{name}", S.SCRIPT_ROWS)]
    logs.write_text(latest.sparkSession, f"{folder}/report.html", [page(latest, min_value, min_prob, names["report-dirs"], names["report-files"])])


def _quoted(column: str) -> Column:
    """A text as a JSON string."""
    array = F.to_json(F.array(column))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def table_filter(latest: DataFrame, text: str = "", category: str | None = None, min_prob: float = S.REPORT_MIN_PROB, verified: str | None = None, sort: str = "value_score", descending: bool = True, page_number: int = 0, page_size: int = 100) -> DataFrame:
    """One page of the filtered and sorted table; ties by value, then first appearance."""
    rows = latest.filter(rules.is_valid()).withColumn("verified", rules.verified_label(F.col("extraction_status")))
    if text:
        rows = rows.filter(F.lower("path").contains(text.lower()))
    if category:
        rows = rows.filter(rules.at_least(rules.probability(category), min_prob))
    if verified:
        rows = rows.filter(F.col("verified") == verified)
    key = rules.probability(sort) if sort in S.CATEGORIES else F.col(sort)
    return rows.orderBy(key.desc() if descending else key.asc(), F.desc("value_score"), "first_seq").offset(page_number * page_size).limit(page_size)
