"""Jobs from the command line: python -m lexweave JOB ... (or spark-submit of this file).

The exit code is 0 for a job that did all it was asked for, 1 for one that could not read its inputs or left terms unanswered,
2 for arguments that cannot be."""

from __future__ import annotations

import argparse
import datetime
import importlib
import os
import sys

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from lexweave.plans import jobs


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexweave", description=__doc__)
    sub = out.add_subparsers(dest="job", required=True)

    def job(name: str, *more: tuple[str, dict]) -> None:
        p = sub.add_parser(name)
        p.add_argument("source")
        p.add_argument("target")
        for flag, options in more:
            p.add_argument(flag, **options)

    corpus = (("--executive", {"default": None}), ("--glossary", {"required": True}), ("--sources", {"nargs": "*", "default": []}))
    job("documents")
    job("summaries", ("--level", {"action": "append", "required": True, "metavar": "STYLE=LEVEL"}))
    job("glossary-document", ("--stop-style", {"default": "references"}), ("--name", {"required": True}))
    job("glossary-lines", ("--start", {"required": True}), ("--stop", {"default": ""}))
    job("glossary-parents", ("--name", {"required": True}))
    job("network", *corpus)
    job("html", *corpus)
    job("pages", ("--page-headers", {"action": "store_true"}))
    key = ("--key-variable", {"metavar": "NAME", "help": "the environment variable that holds the key of a sealed archive"})
    job("archive", ("--file", {"action": "append", "default": [], "help": "a further file of the archive"}), ("--root", {"help": "the folder that members' names begin below"}), key)
    job("unpack", key)
    job(
        "term-summaries", *corpus,
        ("--ask", {"required": True, "metavar": "MODULE:FUNCTION", "help": "a function from a prompt to an answer"}),
        ("--model", {"required": True}),
        ("--prompt", {"required": True, "help": "a file with the prompt's template"}),
        ("--placeholder", {"action": "append", "default": [], "metavar": "NAME=SOURCE"}),
        ("--term", {"action": "append", "default": []}),
        ("--limit", {"type": int}),
        ("--overwrite", {"action": "store_true"}),
        ("--pause-seconds", {"type": float, "default": 0.0}),
    )
    return out


def refused(text: str) -> int:
    print(text, file=sys.stderr)
    return 2


def sealing_key(args: argparse.Namespace) -> str | None:
    if args.key_variable is None:
        return None
    if not os.environ.get(args.key_variable):
        raise ValueError(f"{args.key_variable} is not set")
    return os.environ[args.key_variable]


def term_summaries(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.pause_seconds < 0:
        return refused("--pause-seconds must not be negative")
    if args.limit is not None and args.limit < 1:
        return refused("--limit must be at least 1")
    if any("=" not in x for x in args.placeholder) or ":" not in args.ask:
        return refused("--placeholder is NAME=SOURCE, --ask is MODULE:FUNCTION")
    module, name = args.ask.split(":")
    ask = getattr(importlib.import_module(module), name)
    stamp = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    template = spark.read.text(args.prompt, wholetext=True).first()[0]
    corpus = jobs.Corpus(spark, args.source, args.executive, args.glossary, tuple(args.sources))
    try:
        told = jobs.generate_summaries(corpus, args.target, template, dict(x.split("=", 1) for x in args.placeholder), ask, args.model, stamp, tuple(args.term), args.limit, args.overwrite, args.pause_seconds)
    except jobs.UnknownTerms as e:
        return refused(str(e))
    finally:
        corpus.close()
    print(", ".join(f"{n} {k}" for k, n in told.items()))
    return 1 if told["failed"] else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args, spark or SparkSession.builder.appName("lexweave").getOrCreate())
    except (OSError, RuntimeError, ValueError, PySparkException, Py4JJavaError) as e:
        print(e, file=sys.stderr)
        return 1


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.job == "term-summaries":
        return term_summaries(spark, args)
    if args.job == "documents":
        jobs.convert_documents(spark, args.source, args.target)
    elif args.job == "pages":
        jobs.convert_pages(jobs.read_pages(spark, args.source), args.target, args.page_headers)
    elif args.job == "archive":
        jobs.build_archive(spark, [args.source, *args.file], args.target, sealing_key(args), args.root)
    elif args.job == "unpack":
        jobs.unpack_archive(spark, args.source, args.target, sealing_key(args))
    elif args.job == "summaries":
        jobs.extract_summaries(spark, args.source, args.target, {k: int(v) for k, v in (x.rsplit("=", 1) for x in args.level)})
    elif args.job == "glossary-document":
        jobs.glossary_from_document(spark, args.source, args.target, args.stop_style, args.name)
    elif args.job == "glossary-lines":
        jobs.glossary_from_lines(spark, args.source, args.target, args.start, args.stop)
    elif args.job == "glossary-parents":
        jobs.glossary_with_parents(spark, args.source, args.target, args.name)
    else:
        corpus = jobs.Corpus(spark, args.source, args.executive, args.glossary, tuple(args.sources))
        (jobs.write_network if args.job == "network" else jobs.export_html)(corpus, args.target)
        corpus.close()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
