"""Command line (R18): python -m marrowlake {index,search,related,document,stats} --pack PATH ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marrowlake.api import Engine


def main(argv: list[str] | None = None) -> list[dict]:
    """Runs one command and prints its rows as JSON lines; they are also returned."""
    top = argparse.ArgumentParser(prog="marrowlake")
    top.add_argument("--pack", required=True, help="where the pack lies")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("index", help="publish a pack of two parquet tables")
    one.add_argument("documents")
    one.add_argument("chunks")
    one = sub.add_parser("search", help="keyword search of one text; vectors come from an embedder, which a command line has not")
    one.add_argument("text")
    one.add_argument("--surface", default="mcp", choices=("hook", "mcp"))
    one.add_argument("--least", type=float, default=0.0)
    for name in ("related", "document"):
        sub.add_parser(name).add_argument("id")
    sub.add_parser("stats")
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("marrowlake").getOrCreate()
    e = Engine(spark, a.pack)
    if a.command == "index":
        e.index(spark.read.parquet(a.documents), spark.read.parquet(a.chunks))
        out = e.stats()
    elif a.command == "search":
        asked = spark.createDataFrame([(1, a.text, None)], "query_id long, text string, vec array<float>")
        out = e.search(asked, a.surface, least=a.least).orderBy("position").select("position", "uri", "title", "chunk_id", "score")
    elif a.command == "related":
        out = e.related(spark.createDataFrame([(a.id,)], "id string")).orderBy("position")
    elif a.command == "document":
        out = e.document(a.id)
    else:
        out = e.stats()
    rows = [r[0] for r in out.select(F.to_json(F.struct(*out.columns))).limit(1_000).collect()]  # what a terminal shows
    print(*rows, sep="\n")
    import json

    return [json.loads(r) for r in rows]


if __name__ == "__main__":
    main()
