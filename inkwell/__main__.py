"""python -m inkwell FOLDER [build | search TERM | ask QUESTION | stats | help | TERM]: over a folder of Word documents or with documents.parquet.

`build` writes the index beside the documents, in FOLDER/inkwell; the other commands open it, or build one for this run where there is none. A word that is
no command is searched for. Without a command, commands are read from the terminal until an empty line.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkwell.plans.engine import Engine
from inkwell.runtime import exists, table
from inkwell.sources.readers import word_documents


def documents(spark: SparkSession, folder: str):
    if exists(spark, f"{folder}/documents.parquet"):
        return table(spark, folder, "documents").select("doc_id", "filename", "text")
    return word_documents(spark, folder).select(F.xxhash64("filename").alias("doc_id"), "filename", "text")


def opened(spark: SparkSession, folder: str) -> Engine:
    at = f"{folder}/inkwell"
    return Engine.open(spark, at) if exists(spark, f"{at}/postings/_SUCCESS") else Engine.build(documents(spark, folder))


def run(engine: Engine, words: list[str]) -> None:
    command, text = words[0], " ".join(words[1:])
    if command == "help":
        print(__doc__)
    elif command == "stats":
        engine.stats().show(truncate=False)
    elif command == "ask":
        # batches of contexts, one after the other
        for r in engine.ask(text).orderBy("batch").toLocalIterator():
            print(r.context)
    else:
        engine.search(text if command == "search" else " ".join(words)).show(truncate=120)


def main(args: list[str]) -> int:
    if not args or args == ["help"]:
        print(__doc__)
        return 0 if args else 2
    folder, words = os.path.abspath(args[0]), args[1:]
    spark = SparkSession.builder.appName("inkwell").getOrCreate()
    if words[:1] == ["build"]:
        Engine.build(documents(spark, folder)).save(f"{folder}/inkwell")
        return 0
    engine = opened(spark, folder)
    if words:
        run(engine, words)
    else:
        while line := input("inkwell> ").strip():
            run(engine, line.split())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
