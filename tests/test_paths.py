from pathlib import PurePosixPath, PureWindowsPath

from pyspark.sql import functions as F

from siftwell.functions import paths

CASES = [r"C:\Users\a\b.txt", "C:/saves/x", r"\\server\share\dir\f.md", "/home/a/.env", "/x", "rel/a/b.tar.gz", "name", "/", "C:\\", r"\\server\share\f"]


def _flavour(path: str):
    return PureWindowsPath(path) if path[1:2] == ":" or path.startswith("\\\\") else PurePosixPath(path)


def test_parent_name_and_ancestors_agree_with_the_standard_library(spark):
    rows = spark.createDataFrame([(c,) for c in CASES], "p string").select("p", paths.parent(F.col("p")).alias("up"), paths.name(F.col("p")).alias("name"), paths.ancestors(F.col("p")).alias("all")).collect()
    for row in rows:
        pure = _flavour(row["p"])
        assert row["up"] == str(pure.parent), row
        assert row["name"] == pure.name, row
        assert row["all"] == [str(x) for x in reversed(pure.parents)] or pure.parent == pure, row


def test_extension(spark):
    names = ["a.TXT", ".env", "x.env", "a.tar.gz", "noext", "a.", "..b", ".a.b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", paths.extension(F.col("n")).alias("e")).collect()
    for row in rows:
        assert row["e"] == PurePosixPath(row["n"]).suffix.lstrip(".").lower(), row


def test_join_under_relative_and_long_prefix(spark):
    row = (
        spark.range(1)
        .select(
            paths.join(F.lit("/"), F.lit("a")).alias("j1"),
            paths.join(F.lit("C:\\x"), F.lit("a")).alias("j2"),
            paths.is_under(F.lit("/ab"), F.lit("/a")).alias("no"),
            paths.is_under(F.lit("/a/b"), F.lit("/a")).alias("yes"),
            paths.relative(F.lit("/a/b/c"), F.lit("/a")).alias("rel"),
            paths.top_level(F.lit("/a/b/c"), F.lit("/a")).alias("top"),
            paths.top_level(F.lit("/a/c"), F.lit("/a")).alias("root"),
            paths.strip_extended(F.lit("\\\\?\\C:\\x")).alias("long"),
        )
        .first()
    )
    assert (row["j1"], row["j2"], row["no"], row["yes"], row["rel"], row["top"], row["root"], row["long"]) == ("/a", "C:\\x\\a", False, True, "b/c", "b", "(root)", "C:\\x")
