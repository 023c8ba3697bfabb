"""python -m tarn FOLDER [-name GLOB] [-onlyin PATH] [-count] [-limit N] [--semantic TEXT] [--explain] [QUERY]

Queries a folder of Parquet tables: entries and objects, and content (oid, text, symbols) for text predicates.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tarn import schema
from tarn.engine import Engine
from tarn.functions.vectors import HashEmbedder, embed_chunks
from tarn.operators.lexical import LexicalPlane
from tarn.operators.vector import VectorPlane


def rql(name: str | None, semantic: str | None, query: str | None) -> str:
    """One query of the clauses that are given."""
    clauses = []
    if name:
        clauses.append(f'kMDItemFSName == "*{name}*"c')
    if semantic:
        clauses.append(f'semantic("{semantic}")')
    if query:
        clauses.append(query)
    return " && ".join(clauses)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tarn")
    p.add_argument("folder")
    p.add_argument("query", nargs="?")
    p.add_argument("-name")
    p.add_argument("-onlyin")
    p.add_argument("-count", action="store_true")
    p.add_argument("-limit", type=int, default=schema.CLI_DEFAULT)
    p.add_argument("--semantic")
    p.add_argument("--explain", action="store_true")
    a = p.parse_args(argv)
    query = rql(a.name, a.semantic, a.query)
    if not query:
        p.error("no query")
    spark = SparkSession.builder.appName("tarn").getOrCreate()
    read = lambda t: spark.read.parquet(f"{a.folder.rstrip('/')}/{t}")
    engine = Engine(read("entries"), read("objects"))
    if a.explain:
        print(engine.explain(query))
        return 0
    if '"' in (a.query or "") or a.semantic:
        engine.content = read("content")
        engine.lexical = LexicalPlane.build(engine.content)
        engine.vectors = VectorPlane(embed_chunks(engine.content, HashEmbedder()), HashEmbedder())
    if a.count:
        print(engine.count(query, a.onlyin).first()["n"])
        return 0
    for row in engine.query(query, a.onlyin, limit=a.limit).collect():
        print(row["path"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
