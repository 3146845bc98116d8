"""Commands over an engine's folder: ``python -m pressloom.cli --folder F command``. With ``--json`` results are printed as JSON."""

from __future__ import annotations

import argparse
import json
import logging
from datetime import datetime, timezone

from pressloom.engine import Engine
from pressloom.settings import Preferences, load_settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pressloom", description=__doc__)
    p.add_argument("--folder", required=True, help="where the tables lie")
    p.add_argument("--settings", help="a TOML file")
    p.add_argument("--json", action="store_true")
    p.add_argument("--verbose", action="store_true")
    commands = p.add_subparsers(dest="command", required=True)
    refresh = commands.add_parser("refresh", help="fetch the feeds and store what is new")
    refresh.add_argument("--registry", help="a registry to read first")
    refresh.add_argument("--source", action="append", help="only this source; may be given more than once")
    ask = commands.add_parser("ask", help="answer a question")
    ask.add_argument("text")
    ask.add_argument("--session")
    configure = commands.add_parser("configure", help="store interests")
    configure.add_argument("interests", nargs="*")
    configure.add_argument("--reset", action="store_true")
    for name, text in (("briefing", "make a briefing"), ("latest", "show the newest briefing"), ("status", "show the state"), ("sources", "list the sources"), ("reanalyse", "find topics again")):
        commands.add_parser(name, help=text)
    return p


def shown(value: object, indent: str = "") -> str:
    """A result as lines of text."""
    if isinstance(value, dict):
        return "\n".join(f"{indent}{k}: {v}" if not isinstance(v, (dict, list)) else f"{indent}{k}:\n{shown(v, indent + '  ')}" for k, v in value.items())
    if isinstance(value, list):
        return "\n".join(shown(v, indent) if isinstance(v, dict) else f"{indent}- {v}" for v in value)
    return f"{indent}{value}"


def run(engine: Engine, args: argparse.Namespace, now: datetime) -> object:
    """The result of a command."""
    path = engine._path("preferences.json")
    if args.command == "refresh":
        error = engine.sync_registry(args.registry) if args.registry else None
        return engine.refresh(now, only=args.source) | ({"registry_error": error} if error else {})
    if args.command == "ask":
        return engine.ask(args.text, now, args.session)
    if args.command == "configure":
        if args.reset:
            Preferences.reset(path)
        return Preferences(args.interests, {}).save(path).interests if args.interests else Preferences.load(path).interests
    if args.command == "sources":
        return [r.asDict() for r in engine._table("sources").select("id", "name", "lean", "enabled").orderBy("name").collect()]  # the registry is small
    if args.command == "reanalyse":
        return engine.reanalyse()
    return {"briefing": lambda: engine.briefing(now), "latest": engine.latest_briefing, "status": lambda: engine.status(now)}[args.command]()


def main(arguments: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    args = parser().parse_args(arguments)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    engine = Engine(SparkSession.builder.appName("pressloom").getOrCreate(), args.folder, load_settings(args.settings))
    result = run(engine, args, datetime.now(timezone.utc))
    print(json.dumps(result, default=str, ensure_ascii=False) if args.json else shown(result))


if __name__ == "__main__":
    main()
