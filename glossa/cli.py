"""Command line: python -m glossa.cli build|lookup|reverse-lookup|common-prefix-search|predictive-search|dump ..."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import render
from .functions.bytestrings import display
from .functions.config import DictConfig
from .plans.dictionary import Dictionary
from .plans.stage import intermediate, scratch_path
from .sources.keysets import parse_lines, read_lines

PIECE = 1 << 20  # bytes of input that are held at a time
CACHE_LEVELS = {1: "tiny", 2: "small", 3: "normal", 4: "large", 5: "huge"}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glossa")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("-n", "--num-tries", type=int, default=3)
    b.add_argument("-t", "--text-tail", dest="tail", action="store_const", const="text", default="text")
    b.add_argument("-b", "--binary-tail", dest="tail", action="store_const", const="binary")
    b.add_argument("-w", "--weight-order", dest="order", action="store_const", const="weight", default="weight")
    b.add_argument("-l", "--label-order", dest="order", action="store_const", const="label")
    b.add_argument("-c", "--cache-level", type=int, default=3, choices=CACHE_LEVELS)
    b.add_argument("-o", "--output", required=True)
    b.add_argument("files", nargs="*")
    for name in ("lookup", "reverse-lookup", "common-prefix-search", "predictive-search"):
        q = sub.add_parser(name)
        if name.endswith("search"):
            q.add_argument("-n", "--max-num-results", type=int, default=10)
        q.add_argument("-m", "--mmap-dictionary", action="store_true")
        q.add_argument("-r", "--read-dictionary", action="store_true")
        q.add_argument("dictionary")
    d = sub.add_parser("dump")
    d.add_argument("-d", "--delimiter", default="\n")
    d.add_argument("dictionaries", nargs="+")
    return p


def _lines(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """Numbered lines of a text stream, which is written to the shared folder a piece at a time."""
    path = scratch_path(spark, "lines")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    part, size = [], 0
    for i, x in enumerate(lines):
        part.append(f"{i}\t{x.removesuffix('\n').removesuffix('\r')}\n".encode("utf-8", "surrogateescape"))
        size += len(part[-1])
        if size >= PIECE:
            out.write(bytearray(b"".join(part)))
            part, size = [], 0
    out.write(bytearray(b"".join(part)))
    out.close()
    text = spark.read.schema("line string").option("lineSep", "\n").text(path)
    number = F.substring_index("line", "\t", 1)
    return text.select(number.cast("long").alias("query_id"), F.substring("line", F.char_length(number) + 2, F.char_length("line")).alias("value"))


def _print(df: DataFrame, order: list[str], column: str, end: str, out) -> None:
    for r in df.orderBy(*order).select(column).toLocalIterator():
        out.write(r[0] + end)


def run(spark: SparkSession, argv: list[str], stdin: Iterable[str] = (), out=None, err=None) -> int:
    """Exit codes: 0; 1 a bad argument; 10 unreadable input; 20 a dictionary that can't be opened; 30 a bad query or save."""
    with intermediate(spark):
        return _run(spark, argv, stdin, out or sys.stdout, err or sys.stderr)


def _run(spark: SparkSession, argv: list[str], stdin: Iterable[str], out, err) -> int:
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    if a.command == "build":
        try:
            config = DictConfig(order=a.order, num_tries=a.num_tries, tail=a.tail, cache=CACHE_LEVELS[a.cache_level])
        except ValueError as e:
            err.write(f"{e}\n")
            return 1
        try:
            keys = read_lines(spark, a.files) if a.files else parse_lines(_lines(spark, stdin))
            built = Dictionary.build(keys, config)
        except Exception as e:  # any failure to read is one exit code
            err.write(f"{e}\n")
            return 10
        try:
            d = built.save(a.output)
        except Exception as e:
            err.write(f"{e}\n")
            return 30
        finally:
            built.clear()
        err.write(f"#keys: {d.size()}\n#nodes: {d.num_nodes()}\nsize: {d.io_size()}\n")
        return 0
    if a.command == "dump":
        for path in a.dictionaries:
            try:
                d = Dictionary.load(spark, path)
            except (ValueError, OSError) as e:
                err.write(f"{e}\n")
                return 20
            err.write(f"#keys: {d.size()}\n")
            _print(d.dump().withColumn("t", display("key")), ["dfs_rank"], "t", a.delimiter, out)
        return 0
    try:
        d = Dictionary.load(spark, a.dictionary)
    except (ValueError, OSError) as e:
        err.write(f"{e}\n")
        return 20
    lines = _lines(spark, stdin)
    if a.command == "reverse-lookup":
        ids = lines.select("query_id", F.trim("value").alias("v"), F.trim("value").try_cast("long").alias("key_id"))
        if not ids.where("key_id is null or key_id < 0").isEmpty():
            err.write("invalid key id\n")
            return 30
        found = d.reverse_lookup(ids.select("query_id", "key_id"))
        if not found.where("key is null").isEmpty():
            err.write("key id out of range\n")
            return 30
        _print(found.withColumn("line", F.concat_ws("\t", F.col("key_id").cast("string"), display("key"))), ["query_id"], "line", "\n", out)
        return 0
    queries = lines.select("query_id", F.col("value").cast("binary").alias("query"))
    if a.command == "lookup":
        _print(render.lookup_lines(d.lookup(queries)), ["query_id"], "line", "\n", out)
        return 0
    search = d.common_prefix_search if a.command == "common-prefix-search" else d.predictive_search
    _print(render.search_lines(search(queries, a.max_num_results, keep_missing=True)), ["query_id", "part"], "line", "\n", out)
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("glossa").getOrCreate()
    try:
        return run(spark, sys.argv[1:], sys.stdin)
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
