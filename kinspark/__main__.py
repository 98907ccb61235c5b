"""python -m kinspark --store FOLDER COMMAND: add, build, remove, list, info, fingerprint, scan, explain, compare, decompose, export, import."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinspark", description=__doc__)
    p.add_argument("--store", required=True, help="folder of the reference store, shared by all executors")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("add", "scan", "compare", "fingerprint"):
        c = sub.add_parser(name)
        c.add_argument("path", help="checkpoint folder or file")
        c.add_argument("model_id")
        if name == "add":
            c.add_argument("--overwrite", action="store_true")
    c = sub.add_parser("build")
    c.add_argument("checkpoints", nargs="+", help="model_id=path")
    c.add_argument("--overwrite", action="store_true")
    sub.add_parser("remove").add_argument("model_id")
    sub.add_parser("explain").add_argument("model_id")
    sub.add_parser("list")
    sub.add_parser("info")
    c = sub.add_parser("decompose")
    c.add_argument("path")
    c.add_argument("parents", nargs="+", help="models of the store, or checkpoints")
    c.add_argument("--base", help="a model that all parents come from")
    sub.add_parser("export").add_argument("archive")
    c = sub.add_parser("import")
    c.add_argument("archive")
    c.add_argument("--overwrite", action="store_true")
    return p


def run(session, args) -> int:
    """Run one command and give its exit code: 3 and 4 say what a scan found."""
    if args.command == "add":
        session.add(args.path, args.model_id, args.overwrite)
    elif args.command == "remove":
        return 0 if session.remove(args.model_id) else 1
    elif args.command == "build":
        print("added %d" % session.build(dict(c.split("=", 1) for c in args.checkpoints), args.overwrite))
    elif args.command == "fingerprint":
        model, roles = session.fingerprint(args.path, args.model_id)
        print(model.first().asDict())
        roles.select("role", "sigma", "norms").orderBy("role").show(1000, truncate=80)
    elif args.command == "explain":
        print(session.explain(args.model_id).first())
    elif args.command == "list":
        session.models.models().select("model_id", "family", "n_layers").orderBy("model_id").show(1000, truncate=False)
    elif args.command == "info":
        session.info().orderBy("family").show(1000, truncate=False)
    elif args.command == "scan":
        found = session.scan(args.path, args.model_id)
        row = found.first()
        print(row.asDict())
        return row["exit_code"]
    elif args.command == "compare":
        session.compare(args.path, args.model_id).orderBy("p", ascending=False).show(1000, truncate=False)
    elif args.command == "decompose":
        row = session.decompose(args.path, args.parents, args.base).first()
        print(dict(zip([*args.parents, args.base], row["alphas"])), row["summary"], row["notes"])
    elif args.command == "export":
        session.models.export(f"{args.archive}/models")
        session.roles.export(f"{args.archive}/roles")
    elif args.command == "import":
        print("added %d, skipped %d" % session.models.import_archive(f"{args.archive}/models", args.overwrite))
        session.roles.import_archive(f"{args.archive}/roles", args.overwrite)
    return 0


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .session import LineageSession

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("kinspark").getOrCreate()
    try:
        return run(LineageSession(spark, args.store), args)
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
