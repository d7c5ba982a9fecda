"""Command line: python -m verdigris [-r DIR] [--json] [--export FILE] [--llm] [--rag-embed] PATH..."""

from __future__ import annotations

import argparse
import hashlib
import os
import sys
from pathlib import Path


def confirmed(a: argparse.Namespace) -> bool:
    """Whether the export may be written: yes if it is new, the user says so, or nobody can be asked."""
    if a.yes or not Path(a.export).exists() or not sys.stdin.isatty():
        return True
    return input(f"{a.export} exists. Overwrite? [y/N] ").strip().lower() in ("y", "yes")


def model_of(spark, files, a: argparse.Namespace):
    """A function of files that gives (findings, failed calls) of rules and model, or None if the model cannot be reached."""
    from verdigris.operators import model_review, progress, retrieval
    from verdigris.operators.endpoint import Chat, Embedder
    from verdigris.sources.files import project_root

    chat = Chat.resolve()
    if problem := chat.check_runtime():
        print(f"no model review: {problem}", file=sys.stderr)
        return None
    context, root = None, project_root([*a.paths, *([a.recursive] if a.recursive else [])]) or "."
    if a.rag_embed:
        encoder = Embedder()
        index = progress.watched(spark, lambda: retrieval.CodeIndex.open(spark, retrieval.default_path(root), files, encoder, encoder.model), shown("index"))
        for row in index.embedding_failure().collect():
            print(f"{row['chunks']} chunks have no embedding and are related by structure alone: {row['error']}", file=sys.stderr)
        context = model_review.Context.of(index)
    client, journal = model_review.Client(chat, tries=1), f"{retrieval.default_path(root)}/answers-{hashlib.sha256(f'{chat.url} {chat.model}'.encode()).hexdigest()[:16]}"
    return lambda some: model_review.review_with_model(some, client, context, workers=1, in_flight=a.workers, journal=journal, progress=shown("model"))


def shown(what: str):
    """A function of (done, total) that shows them on a terminal's error output."""
    return (lambda done, total: print(f"\r{what}: {done}/{total}", end="" if done < total else "\n", file=sys.stderr, flush=True)) if sys.stderr.isatty() else (lambda done, total: None)


#: Files that are reviewed with the model before their reports are printed.
SLICE = 50


def printed(files, found, as_json: bool, link: bool) -> None:
    """Prints the reports of files: clean files first, then dirty ones."""
    from verdigris.operators import report

    if as_json:
        for row in report.json_reports(files, found).toLocalIterator():
            print(row["json"], flush=True)
        return
    dirty = found.select("path").distinct()
    for some in (files.join(dirty, "path", "left_anti"), files.join(dirty, "path", "left_semi")):
        for row in report.text_lines(some, found.join(some.select("path"), "path", "left_semi")).toLocalIterator():
            name = report.hyperlink(f"file://{Path(row['path']).resolve()}", row["path"]) if link else row["path"]
            print(f"── {name} ──\n{row['rendered']}", flush=True)


def main(argv: list[str] | None = None) -> int:
    """0 if all files were reviewed, 1 if any could not be, 2 without a path."""
    p = argparse.ArgumentParser(prog="verdigris", description="Reviews Python files with Spark.")
    p.add_argument("paths", nargs="*")
    p.add_argument("-r", "--recursive", metavar="DIR", help="review all Python files below DIR")
    p.add_argument("--json", action="store_true", help="one JSON object for each file")
    p.add_argument("--export", metavar="FILE", nargs="?", const="verdigris_findings.txt", help="also write the findings of dirty files as text")
    p.add_argument("--yes", action="store_true", help="overwrite without asking")
    p.add_argument("--no-links", action="store_true", help="plain paths even on a terminal")
    p.add_argument("--llm", action="store_true", help="also ask the model; see VERDIGRIS_LLM_URL, _KEY and _MODEL")
    p.add_argument("--rag-embed", action="store_true", help="with --llm: compare files with related code, found by structure and embeddings")
    p.add_argument("--workers", type=int, default=4, help="calls of the model at a time")
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(argv)
    if not a.paths and not a.recursive:
        p.print_usage(sys.stderr)
        return 2
    missing = [x for x in [*a.paths, *([a.recursive] if a.recursive else [])] if not Path(x).exists()]
    if missing or a.recursive and not Path(a.recursive).is_dir():
        print("not found: " + ", ".join(missing or [a.recursive]), file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from verdigris.operators import report
    from verdigris.operators.progress import in_slices
    from verdigris.operators.scratch import keep
    from verdigris.sources import files as src

    spark = SparkSession.builder.master(a.master).appName("verdigris").getOrCreate()
    folder = [x for x in a.paths if Path(x).is_dir()] + ([a.recursive] if a.recursive else [])
    if folder and not any(next(Path(f).rglob("*.py"), None) for f in folder) and not [x for x in a.paths if Path(x).is_file()]:
        print("no Python files")
        return 0
    parts = [src.read_folder(spark, str(Path(f).resolve())) for f in folder if next(Path(f).rglob("*.py"), None)] + [src.read_file(spark, x) for x in a.paths if Path(x).is_file()]
    files = parts[0]
    for x in parts[1:]:
        files = files.unionByName(x)
    files = files.persist()
    broken = report.errors(files).collect()
    good = files.join(report.errors(files), "path", "left_anti").persist()
    failed, link = [], sys.stdout.isatty() and not a.no_links and os.environ.get("TERM", "dumb") != "dumb"
    if a.llm and (review := model_of(spark, good, a)):

        def part(some):
            own, lost = review(some)
            own = keep(own, "findings")
            return some, own, lost.collect()

        found = None
        for some, own, lost in in_slices(good, part, size=SLICE, at_once=1):  # the model answers some calls at a time, whatever slice they are of
            printed(some, own, a.json, link)
            found, failed = own if found is None else found.unionByName(own), failed + lost
    else:
        found = keep(report.review(good), "findings")
        printed(good, found, a.json, link)
    if not a.json:
        print(report.summary_text(report.summary(good, found).first()))
    if a.export and confirmed(a):
        report.write_one_text(found, a.export)
    for row in failed:
        print(f"{row['path']}: {row['focus']}: {row['error']}", file=sys.stderr)
    for row in broken:
        print(f"{row['path']}: {row['error']}", file=sys.stderr)
    for cached in (good, files):
        cached.unpersist()
    return int(bool(broken))
