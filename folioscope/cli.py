"""Command line: one envelope as JSON on standard output; exit code 0 if it is ok, 1 if not, 2 for wrong usage."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from folioscope.engine import Engine


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folioscope")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *positional: str, **options: dict[str, Any]) -> None:
        c = commands.add_parser(name)
        for p in positional:
            c.add_argument(p, nargs="+" if p in ("keywords", "inputs") else None)
        for option, said in options.items():
            c.add_argument("--" + option.replace("_", "-"), **said)

    flag, text = {"action": "store_true"}, {"default": None}
    axes = {"case_sensitive": flag, "substring": flag}
    add("capabilities")
    add("list")
    for name in ("register", "info", "remove"):
        add(name, "reference")
    add("search", "reference", "keywords", pages=text, **axes)
    add("search-corpus", "keywords", directory=text, pages=text, recursive=flag, sort={"default": "path"}, **axes)
    add("extract-text", "reference", pages=text)
    add("extract-links", "reference", pages=text)
    add("cut", "reference", "pages", "output")
    around = {"before": {"type": int, "default": 1}, "after": {"type": int, "default": 1}}
    add("context", "reference", "anchor", **around)
    add("extract-context", "reference", "anchor", "output", **around)
    add("extract-matches", "reference", "output", "keywords", padding={"type": int, "default": 2}, pages=text, **axes)
    add("merge", "output", "inputs")
    add("merge-folder", "directory", output=text, recursive=flag, numeric_prefix=flag)
    add("render-pages", "reference", pages=text, dpi={"type": int, "default": 150})
    add("render-thumbnails", "reference", pages=text, scale={"type": float, "default": 0.3})
    add("render-to-files", "reference", output_dir=text, pages=text, dpi={"type": int, "default": 150}, prefix=text)
    add("speak", "text", save_path=text, speak_aloud=flag, rate={"type": int, "default": None}, volume={"type": float, "default": None})
    return top


def _anchor(text: str) -> int | str:
    """Digits are a page number, anything else a keyword."""
    return int(text) if text.isdecimal() else text


def dispatch(engine: Engine, a: argparse.Namespace) -> dict[str, Any]:
    axes = {"case_sensitive": getattr(a, "case_sensitive", False), "whole_words": not getattr(a, "substring", False)}
    calls: dict[str, Callable[[], dict[str, Any]]] = {
        "capabilities": lambda: engine.capabilities(),
        "list": lambda: engine.list_documents(),
        "register": lambda: engine.register(a.reference),
        "info": lambda: engine.document_info(a.reference),
        "remove": lambda: engine.remove_document(a.reference),
        "search": lambda: engine.search(a.reference, a.keywords, a.pages, **axes),
        "search-corpus": lambda: engine.search_corpus(a.keywords, a.directory, a.pages, recursive=a.recursive, sort=a.sort, **axes),
        "extract-text": lambda: engine.extract_text(a.reference, a.pages),
        "extract-links": lambda: engine.extract_links(a.reference, a.pages),
        "cut": lambda: engine.cut_pages(a.reference, a.pages, a.output),
        "context": lambda: engine.context_pages(a.reference, _anchor(a.anchor), a.before, a.after),
        "extract-context": lambda: engine.extract_context(a.reference, _anchor(a.anchor), a.output, a.before, a.after),
        "extract-matches": lambda: engine.extract_matches(a.reference, a.keywords, a.output, a.padding, a.pages, **axes),
        "merge": lambda: engine.merge(a.inputs, a.output),
        "merge-folder": lambda: engine.merge_folder(a.directory, a.output, a.recursive, a.numeric_prefix),
        "render-pages": lambda: engine.render_pages(a.reference, a.pages, a.dpi),
        "render-thumbnails": lambda: engine.render_thumbnails(a.reference, a.pages, a.scale),
        "render-to-files": lambda: engine.render_to_files(a.reference, a.output_dir, a.pages, a.dpi, a.prefix),
        "speak": lambda: engine.synthesize_speech(a.text, a.save_path, a.speak_aloud, a.rate, a.volume),
    }
    return calls[a.command]()


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    a = parser().parse_args(argv)
    result = dispatch(engine or Engine(SparkSession.builder.appName("folioscope").getOrCreate()), a)
    json.dump(result, sys.stdout, ensure_ascii=False)
    sys.stdout.write("\n")
    return 0 if result["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
