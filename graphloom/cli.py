"""A console over a session: questions, and commands that begin with a colon."""

from __future__ import annotations

import argparse
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

from graphloom.operators.lifecycle import library_summary
from graphloom.plans.narration import load_narrator, narrate, one_prompt
from graphloom.plans.session import Session
from graphloom.session import shared_folder, workers_find_package
from graphloom.sources.library import load_library, save_library

HELP = ":ingest PATH | :speculate STATEMENT | :confirm ID | :rollback ID | :stats | :library | :save | :help | :quit"


def answer(session: Session, line: str, library: str | None = None, narrator: Callable[..., Iterator[str]] | None = None, model: str = "") -> str | None:
    """What one line of input gives; None ends the console. With a narrator a question's paths are followed by what it makes of them."""
    word, _, rest = line.strip().partition(" ")
    if word in (":quit", ":exit", ":q"):
        return None
    if not word:
        return ""
    if not word.startswith(":"):
        began = time.time()
        records = session.query(line)
        lines = [f"{p['rank']}. {p['conductivity']:.3f}  {' → '.join(p['path'])}" for p in records]
        told = "".join(narrate(one_prompt(line, records, model), narrator)) if narrator and records else ""
        return "\n".join([*lines, f"{len(lines)} paths, {1000 * (time.time() - began):.0f} ms", *([told] if told else [])])
    if word == ":ingest":
        return str(session.ingest_files(rest.split()))
    if word == ":speculate":
        return session.speculate(rest)
    if word == ":confirm":
        return str(session.confirm(rest) or "confirmed")
    if word == ":rollback":
        return "rolled back" if session.rollback(rest) else "some change is left"
    if word == ":stats":
        return str(session.stats())
    if word == ":library":
        return str(library_summary(session.library).first().asDict() | {"observations": session.library.observations.count()})
    if word == ":save":
        return safe_save(session, library) if library else "no library path was given"
    return HELP if word == ":help" else f"unknown command; {HELP}"


def safe_save(session: Session, library: str) -> str:
    """Saves the library and says so; an error is said too, and ends nothing."""
    try:
        return str(save_library(session.library, library))
    except Exception as e:
        return f"the library was not saved: {type(e).__name__}: {e}"


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--files", nargs="*", default=[])
    parser.add_argument("--watch")
    parser.add_argument("--library")
    parser.add_argument("--model", help="a local model file that tells what the paths mean")
    parser.add_argument("--no-synth", action="store_true", help="paths only, whatever the model")
    parser.add_argument("--demo", metavar="QUESTION", help="ask one question of the files (or of a sample text), print what comes and end")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    workers_find_package(spark)
    narrator = None if args.no_synth else load_narrator(args.model)
    folder = f"{shared_folder(spark)}/console"
    if args.demo:
        print(run_demo(spark, folder, args.demo, args.files, narrator, args.model or ""))
        return
    try:
        library = load_library(spark, args.library) if args.library else None
    except FileNotFoundError:
        library = None
    session = Session(spark, folder, library=library)
    if args.files:
        print(session.ingest_files(args.files))
    watcher = None
    if args.watch:
        from graphloom.streaming.watch import Watcher

        watcher = Watcher(spark, os.path.expanduser(args.watch), f"{folder}/watch", session.ingest_documents).start()
    try:
        while (out := answer(session, input("> "), args.library, narrator, args.model or "")) is not None:
            print(out)
    except (EOFError, KeyboardInterrupt):
        pass
    finally:
        if watcher:
            watcher.stop()
        print(session.end())
        if args.library:
            print(safe_save(session, args.library))


SAMPLE = "Solar panels convert sunlight into electricity. Electricity from panels charges large batteries. Large batteries keep the grid stable at night. A stable grid lets cities close coal plants. Closed coal plants lower the emissions of cities."


def run_demo(spark: SparkSession, folder: str, question: str, files: list[str] = (), narrator: Callable[..., Iterator[str]] | None = None, model: str = "") -> str:
    """One session from start to end: the files or a sample text go in, a question is asked, a statement is tried and taken back, the library learns."""
    session = Session(spark, folder)
    out = [str(session.ingest_files(list(files)) if files else session.ingest_text(SAMPLE)), answer(session, question, None, narrator, model)]
    spec = session.speculate(question)
    out += [f"tried as a statement: {session.stats()['sem_active']} edges change", answer(session, f":rollback {spec}"), answer(session, ":stats"), str(session.end()), answer(session, ":library")]
    return "\n".join(out)


if __name__ == "__main__":
    main()
